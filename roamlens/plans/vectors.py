"""Vectors, topic texts, samples, the sensitivity ladder and the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions import vocab
from roamlens.functions.language import coarse_language
from roamlens.operators import models, sampling, topics
from roamlens.plans.corpus import BANGLA_TEXTS, BN, bangla_texts
from roamlens.plans.registry import query
from roamlens.sources.adapters import Tables

STOP = ["the", "and", "of", "to", "in", "is", "en", "der", "la", "de", *vocab.BANGLA_STOP_WORDS]
STOP_SQL = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


# ---- vectors ------------------------------------------------------------------------------
def clustered(t: Tables):
    """Embeddings with their label as topic; every seventh one is an outlier."""
    return t.raw("embeddings").selectExpr("vec_id", "embedding", "CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS topic_id")


UNIT = "list_transform({v}, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])), 1e-12))"
CLUSTERED = f"""clustered AS MATERIALIZED (SELECT vec_id, {UNIT.format(v='embedding')} AS u, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS topic_id FROM embeddings),
means AS (SELECT topic_id, i, avg(x) AS x FROM (SELECT topic_id, unnest(range(1, 65)) AS i, unnest(u) AS x FROM clustered WHERE topic_id <> -1) GROUP BY 1, 2),
packed AS (SELECT topic_id, list(x ORDER BY i) AS v FROM means GROUP BY 1), centroids AS MATERIALIZED (SELECT topic_id, {UNIT.format(v='v')} AS c FROM packed)"""
query("topic_2_reassign_outliers", f"""WITH {CLUSTERED},
best AS (SELECT vec_id, a.topic_id AS raw, c.topic_id, list_dot_product(u, c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, c.topic_id) AS rn
  FROM clustered a JOIN centroids c ON a.topic_id = -1 OR a.topic_id = c.topic_id)
SELECT vec_id, raw AS topic_id_raw, topic_id, CASE WHEN raw = -1 THEN 'reassigned' ELSE 'cluster' END AS topic_assignment, round(s, 6) AS topic_similarity FROM best WHERE rn = 1
""")(lambda t: topics.reassign_outliers(clustered(t)))


def topic_vectors(t: Tables):
    """Topic vectors: one large and some small topics per label."""
    v = t.raw("embeddings").selectExpr("label * 4 + CASE WHEN vec_id % 25 < 22 THEN 0 ELSE vec_id % 25 - 21 END AS topic_id", "embedding")
    n = v.groupBy("topic_id").agg(F.count(F.lit(1)).alias("review_count"))
    return topics.centroids(v).withColumnRenamed("centroid", "vector").join(n, "topic_id")


def preference_vectors(t: Tables):
    v = t.raw("embeddings").selectExpr("concat('V', label) AS topic_id", "embedding")
    return topics.centroids(v).withColumnRenamed("topic_id", "preference_id").withColumnRenamed("centroid", "vector")


def _centroid_sql(name: str, key: str) -> str:
    return f"""{name}_m AS (SELECT k, i, avg(x) AS x FROM (SELECT {key} AS k, unnest(range(1, 65)) AS i, unnest({UNIT.format(v='embedding')}) AS x FROM embeddings) GROUP BY 1, 2),
{name}_p AS (SELECT k, list(x ORDER BY i) AS v FROM {name}_m GROUP BY 1), {name} AS MATERIALIZED (SELECT k, {UNIT.format(v='v')} AS v FROM {name}_p)"""


TOPIC_KEY = "label * 4 + CASE WHEN vec_id % 25 < 22 THEN 0 ELSE vec_id % 25 - 21 END"
COSINES = f"WITH {_centroid_sql('tv', TOPIC_KEY)}, {_centroid_sql('pv', chr(99) + 'oncat(' + chr(39) + 'V' + chr(39) + ', label)')}"
query("topic_7_cosine_scores", COSINES + """
SELECT CAST(tv.k AS BIGINT) AS topic_id, pv.k AS preference_id, round(list_dot_product(tv.v, pv.v), 6) AS similarity FROM tv CROSS JOIN pv
""")(lambda t: topics.cosine_scores(topic_vectors(t), preference_vectors(t)).withColumn("similarity", F.round("similarity", 6)))
query("topic_8_long_tail", f"""WITH {_centroid_sql('tv', TOPIC_KEY)}, n AS (SELECT {TOPIC_KEY} AS k, count(*) AS c FROM embeddings GROUP BY 1),
cut AS (SELECT least(0.02::DOUBLE, 0.5::DOUBLE / count(*)) AS cut, sum(c) AS total FROM n),
s AS MATERIALIZED (SELECT tv.k, v, c, c::DOUBLE / total AS share, cut FROM tv JOIN n USING (k), cut),
m AS (SELECT a.k, coalesce(max(list_dot_product(a.v, b.v)), 0) AS m FROM s a LEFT JOIN s b ON b.share >= b.cut AND b.k <> a.k GROUP BY 1)
SELECT CAST(k AS BIGINT) AS topic_id, c AS review_count, round_even(share, 4) AS corpus_share, share < cut AS scarce, round_even(m, 4) AS max_sim_to_abundant, round_even(1 - m, 4) AS sdd, 0.6::DOUBLE AS sdd_threshold,
  cut AS scarcity_threshold, CASE WHEN share < cut AND 1 - m > 0.6 THEN 'long_tail' ELSE 'mainstream' END AS preference_type, share < cut AND 1 - m > 0.6 AS is_long_tail FROM s JOIN m USING (k)
""")(lambda t: topics.long_tail_flags(topic_vectors(t)))


def aligned(t: Tables):
    """Each vector and its translation: the vector with a tenth of its components moved."""
    return t.raw("embeddings").selectExpr("vec_id AS id", "embedding AS passage", "transform(embedding, (x, i) -> CASE WHEN i % 2 = vec_id % 2 THEN x ELSE CAST(0 AS float) END) AS query")


query("topic_19_retrieval_accuracy", f"""WITH a AS MATERIALIZED (SELECT vec_id AS id, {UNIT.format(v='embedding')} AS p, {UNIT.format(v='qv')} AS q FROM (
  SELECT vec_id, embedding, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 2 = vec_id % 2 THEN x ELSE 0::FLOAT END) AS qv FROM embeddings)),
own AS (SELECT id, q, list_dot_product(q, p) AS s FROM a), r AS (SELECT own.id, 1 + count(*) FILTER (list_dot_product(own.q, a.p) > s + 1e-9) AS rank FROM own CROSS JOIN a GROUP BY 1)
SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS acc_at_1, round(avg((rank <= 5)::INT), 6) AS acc_at_5 FROM r
""")(lambda t: sampling.retrieval_accuracy(aligned(t)))
query("topic_1_clusters")(lambda t: models.topic_clusters(
    t.raw("embeddings").withColumn("language_group", F.when(F.col("label") < 5, "bn").otherwise("other")), "language_group"))

# ---- topic texts --------------------------------------------------------------------------------
query("topic_3_keywords", f"""
WITH words AS (SELECT source AS topic_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\x{{0980}}-\\x{{09ff}}]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w)) AS w FROM documents),
terms AS (SELECT topic_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words),
tf AS MATERIALIZED (SELECT topic_id, term, count(*) AS n FROM terms GROUP BY 1, 2), pt AS (SELECT topic_id, sum(n) AS topic_terms FROM tf GROUP BY 1), f AS (SELECT term, sum(n) AS all_n FROM tf GROUP BY 1)
SELECT topic_id, rank, term, weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM (
SELECT topic_id, term, round(n::DOUBLE / topic_terms * ln(1 + (SELECT avg(topic_terms) FROM pt) / all_n), 8) AS weight FROM tf JOIN f USING (term) JOIN pt USING (topic_id))) WHERE rank <= 10
""")(lambda t: topics.keywords(t.texts.selectExpr("source AS topic_id", "review_text AS text"), STOP))


def topic_reviews(t: Tables):
    """Documents with language as topic and source as place."""
    return t.texts.selectExpr("review_language AS topic_id", "place_name", "review_id", "review_text")


query("topic_5_place_mix", """
SELECT topic_id, string_agg(concat(place, ' (', n, ')'), '; ' ORDER BY rn) AS place_mix FROM (SELECT lang AS topic_id, source AS place, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rn
FROM documents GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1
""")(lambda t: topics.place_mix(topic_reviews(t)))
query("topic_6_diverse_samples", """
WITH t AS (SELECT lang AS topic_id, source AS place, doc_id AS review_id, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS line,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn, count(*) OVER (PARTITION BY lang, source) AS size FROM documents)
SELECT topic_id, rank, place, review_id, CASE WHEN length(line) > 280 THEN concat(regexp_replace(substr(line, 1, 277), '\\s+$', ''), '...') ELSE line END AS sample FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY turn, size DESC, place) AS INTEGER) AS rank FROM t) WHERE rank <= 5
""")(lambda t: topics.diverse_samples(topic_reviews(t)))
query("topic_20_aligned_pairs", f"""WITH {BANGLA_TEXTS}, c AS (SELECT review_id, b.source AS place_name, review_text AS bn, text AS en, len(regexp_extract_all(review_text, '{BN}')) AS b1, len(regexp_extract_all(review_text, '[A-Za-z]')) AS l1,
  len(regexp_extract_all(text, '[A-Za-z]')) AS l2 FROM bangla_texts b JOIN documents ON doc_id = review_id)
SELECT review_id, place_name, bn, en FROM c WHERE bn <> en AND b1 > 0 AND b1::DOUBLE / (b1 + l1) > 0.5 AND l2 > 0
""")(lambda t: sampling.aligned_pairs(bangla_texts(t).selectExpr("review_id", "place_name", "review_text AS review_text_original").join(
    t.texts.selectExpr("review_id", "review_text AS review_text_clean"), "review_id")))


# ---- samples ---------------------------------------------------------------------------------------
def pair_sample(t: Tables):
    return sampling.mapping_sample(t.topic_mapping, t.topic_scores)


query("topic_13_mapping_sample")(pair_sample)


def theme_reviews(t: Tables):
    """Documents spread over the part topics."""
    return t.texts.selectExpr("CAST(review_id % 25 + 1 AS int) AS topic_id", "place_name", "review_id", "review_text")


query("topic_14_topic_examples", """
WITH mid AS (SELECT CAST(doc_id % 25 + 1 AS INTEGER) AS topic_id, source AS place_name, doc_id AS review_id, text AS review_text FROM documents WHERE length(text) BETWEEN 60 AND 420),
marked AS (SELECT *, CASE WHEN review_id = min(review_id) OVER (PARTITION BY topic_id, place_name) THEN 0 ELSE 1 END AS later FROM mid),
once AS (SELECT *, row_number() OVER (PARTITION BY topic_id, review_text ORDER BY later, review_id) AS k FROM marked)
SELECT topic_id, place_name, review_id, review_text, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY later, review_id) AS INTEGER) AS rank FROM once WHERE k = 1) WHERE rank <= 4
""")(lambda t: sampling.topic_examples(theme_reviews(t)).select("topic_id", "place_name", "review_id", "review_text", "rank"))
query("topic_14_blinded_sheet")(lambda t: sampling.blinded_sheet(
    pair_sample(t), sampling.topic_examples(theme_reviews(t)), t.topics, t.preferences, "annotator-1"))
query("topic_15_annotation_pool")(lambda t: sampling.annotation_pool(t.texts.withColumnRenamed("review_text", "text")))
query("topic_16_sample_ladder")(lambda t: sampling.ladder(t.reviews))
query("topic_16_ladder_sizes", """
SELECT i AS rung, CAST(round_even(f * (SELECT count(*) FROM reviews), 0) AS BIGINT) AS n FROM (SELECT unnest([1, 2, 3, 4]) AS i, unnest([0.28::DOUBLE, 0.46::DOUBLE, 0.74::DOUBLE, 1.0::DOUBLE]) AS f)
""")(lambda t: sampling.ladder(t.reviews).groupBy("rung").agg(F.count(F.lit(1)).alias("n")))


def rung_mappings(t: Tables):
    """The topic mapping recomputed on growing shares of the parts."""
    p = t.raw("part").selectExpr("p_partkey % 4 AS m", "CAST(substr(p_brand, 7) AS int) AS topic_id", "concat('P-', p_type) AS preference_id")
    r = p.select("topic_id", "preference_id", F.explode(F.expr("sequence(CAST(m AS int) + 1, 4)")).alias("rung"))
    cell = r.groupBy("rung", "topic_id", "preference_id").agg(F.count(F.lit(1)).alias("n"))
    total = cell.groupBy("rung", "topic_id").agg(F.sum("n").alias("total"), F.max_by("preference_id", F.struct("n", "preference_id")).alias("preference_id"), F.max("n").alias("n"))
    return total.filter("topic_id % (6 - rung) = 0").select("rung", "topic_id", "preference_id", F.round(F.least(F.lit(1.0), F.col("n") * 2.2 / F.col("total")), 6).alias("similarity"))


RUNGS = """rung_mappings AS MATERIALIZED (SELECT rung, topic_id, preference_id, round(least(1.0::DOUBLE, n * 2.2::DOUBLE / total), 6) AS similarity FROM (SELECT *, sum(n) OVER (PARTITION BY rung, topic_id) AS total,
  row_number() OVER (PARTITION BY rung, topic_id ORDER BY n DESC, preference_id DESC) AS rn FROM (SELECT CAST(rung AS INTEGER) AS rung, CAST(substr(p_brand, 7) AS INTEGER) AS topic_id, concat('P-', p_type) AS preference_id, count(*) AS n
  FROM part JOIN (SELECT unnest([1, 2, 3, 4]) AS rung) ON rung > p_partkey % 4 GROUP BY 1, 2, 3)) WHERE rn = 1 AND topic_id % (6 - rung) = 0),
rung_sets AS (SELECT rung, count(DISTINCT topic_id) AS n_topics, list_sort(list(DISTINCT preference_id)) AS ids, round_even(avg(similarity), 4) AS avg_similarity,
  round_even(avg((similarity >= 0.4)::INT), 4) AS high_confidence_rate FROM rung_mappings GROUP BY 1),
metrics AS MATERIALIZED (SELECT rung, n_topics, CAST(len(ids) AS INTEGER) AS n_preferences_covered, round_even(len(ids)::DOUBLE / (SELECT count(DISTINCT p_type) FROM part), 4) AS coverage_rate, avg_similarity, high_confidence_rate,
  round_even(coalesce(len(list_intersect(ids, prev))::DOUBLE / len(list_distinct(ids || prev)), 1.0), 4) AS jaccard_vs_previous FROM (SELECT *, lag(ids) OVER (ORDER BY rung) AS prev FROM rung_sets))"""


def rung_metrics(t: Tables):
    return sampling.sensitivity_metrics(rung_mappings(t), t.preference_classes.agg(F.count(F.lit(1))).scalar())


query("topic_17_sensitivity_metrics", f"WITH {RUNGS} SELECT * FROM metrics")(rung_metrics)
query("topic_18_stability_points", f"""WITH {RUNGS}, h AS (SELECT rung, jaccard_vs_previous >= 0.95 AS ok, row_number() OVER (ORDER BY rung) AS i,
  min((jaccard_vs_previous >= 0.95)::INT) OVER (ORDER BY rung ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM metrics)
SELECT min(rung) FILTER (i > 1 AND ok) AS first_passing, coalesce(min(rung) FILTER (i > 1 AND held = 1), max(rung)) AS stable_from FROM h
""")(lambda t: sampling.stability_points(rung_metrics(t)))
query("ret_16_rung_mappings", f"WITH {RUNGS} SELECT rung, topic_id, preference_id, similarity FROM rung_mappings")(rung_mappings)
query("ret_16_sample_by_type")(lambda t: pair_sample(t).filter("pair_type = 'hard_negative'").orderBy(F.desc("similarity"), "topic_id", "preference_id"))


# ---- models ---------------------------------------------------------------------------------------
def language_examples(t: Tables):
    return t.texts.select(F.col("review_text").alias("text"), F.col("review_language").alias("label")).filter("length(text) >= 10")


def detected(t: Tables):
    model, classes = models.train(language_examples(t))
    return models.predict(model, classes, t.texts.selectExpr("review_id", "review_text AS text"))


query("lng_6_language_detector")(lambda t: detected(t).select("review_id", F.col("predicted").alias("detected_iso"), F.round("confidence", 4).alias("confidence")))
query("pre_12_detected_language")(lambda t: detected(t).select("review_id", coarse_language(F.col("text"), F.col("predicted")).alias("detected_language")))
query("lng_7_majority_labels", """
SELECT text, arg_max(label, n) AS label FROM (SELECT text, label, count(*) AS n, max(count(*)) OVER (PARTITION BY text) AS top FROM (
  SELECT text, quality AS label FROM labels JOIN documents USING (doc_id) UNION ALL SELECT text, 1 - toxic FROM labels JOIN documents USING (doc_id)) GROUP BY 1, 2) WHERE n = top GROUP BY 1 HAVING count(*) = 1
""")(lambda t: models.majority_labels(_votes(t)))
query("lng_7_cross_validation")(lambda t: models.cross_validate(
    models.majority_labels(_votes(t)).select("text", F.when(F.col("label") == 1, "keep").otherwise("drop").alias("label"))))


def _votes(t: Tables):
    d = t.raw("labels").join(t.raw("documents").select("doc_id", "text"), "doc_id")
    return d.select("text", F.col("quality").alias("label")).unionByName(d.select("text", (1 - F.col("toxic")).alias("label")))
