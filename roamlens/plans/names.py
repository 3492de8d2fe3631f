"""Mention extraction, grounding, blocked pairs, resolution and mined spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions import language as L
from roamlens.functions import text as T
from roamlens.functions.similarity import fuzzy_ratio
from roamlens.operators import alike, joins, mentions, mining, resolution
from roamlens.plans.corpus import BANGLA_TEXTS, bangla_texts, squeeze_sql
from roamlens.plans.registry import query
from roamlens.session import cut_lineage
from roamlens.sources.adapters import Tables

WORD = "[\\p{L}\\p{N}_\\x{0980}-\\x{09ff}]"


# ---- name lists from the benchmark passages ------------------------------------------------------
def name_rows(t: Tables):
    """Neighbouring word pairs of the benchmark passages, as place names."""
    w = t.raw("benchmark").select(F.expr("regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+', 0)").alias("w"))
    return w.select(F.explode("w").alias("place_name")).distinct()


def names(t: Tables):
    return mentions.gazetteer(name_rows(t).filter("length(place_name) >= 10"))


def lexicon(t: Tables):
    """Long words of the benchmark passages, as foods and activities; short ones join terms of two words."""
    w = t.raw("benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+( [a-z]{3,5})?', 0)")).alias("surface")).distinct()
    return w.filter("length(surface) >= 9").selectExpr(
        "surface", "CASE WHEN length(surface) % 2 = 0 THEN 'FOOD' ELSE 'ACTIVITY' END AS entity_type", "upper(surface) AS concept")


NAMES_SQL = """names AS MATERIALIZED (SELECT DISTINCT n AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+')) AS p FROM benchmark),
  LATERAL (SELECT CASE WHEN regexp_replace(p, '(?i)^the\\s+', '') = '' THEN p ELSE regexp_replace(p, '(?i)^the\\s+', '') END AS n) WHERE length(p) >= 10 AND length(n) >= 4)"""
query("men_1_gazetteer", f"WITH {NAMES_SQL} SELECT name FROM names")(names)


def place_mentions(t: Tables):
    return mentions.place_mentions(t.texts, names(t))


SPANS_SQL = f"""{NAMES_SQL}, hits AS MATERIALIZED (SELECT doc_id AS review_id, source, text, name FROM documents JOIN names ON contains(lower(text), lower(name))),
parts AS (SELECT review_id, text, name, unnest(string_split(lower(text), lower(name))) AS piece, generate_subscripts(string_split(lower(text), lower(name)), 1) AS i FROM hits),
cuts AS (SELECT review_id, text, name, i, CAST(sum(length(piece)) OVER (PARTITION BY review_id, name ORDER BY i) + (i - 1) * length(name) AS BIGINT) AS s,
  max(i) OVER (PARTITION BY review_id, name) AS last FROM parts),
spans AS MATERIALIZED (SELECT review_id, name, s AS start, s + length(name) AS "end", substr(text, s + 1, length(name)) AS surface FROM cuts WHERE i < last
  AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END, '{WORD}') AND NOT regexp_matches(substr(text, s + length(name) + 1, 1), '{WORD}')),
kept_spans AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.review_id = a.review_id AND b.start <= a.start AND b."end" >= a."end" AND (b."end" - b.start > a."end" - a.start OR b.name < a.name)))"""
query("men_2_place_mentions", f"""WITH {SPANS_SQL}
SELECT review_id, 'PLACE' AS entity_type, surface, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", name FROM kept_spans
""")(place_mentions)
query("men_3_lexicon_mentions")(lambda t: mentions.lexicon_mentions(t.texts, lexicon(t), place_mentions(t)))
query("men_4_cue_mentions")(lambda t: mentions.cue_mentions(t.texts.withColumn(
    "review_text", F.concat(F.regexp_replace("review_text", " the ", " boat from Old Harbour to "), F.lit(" Carry water and go early in winter, best time is spring.")))))
query("men_5_term_boundaries", f"""
SELECT doc_id AS review_id, len(regexp_extract_all(lower(text), '{WORD}+')) - len(list_filter(regexp_extract_all(lower(text), '{WORD}+'), lambda w: w NOT IN ('that', 'thats', 'thates'))) AS n FROM documents
""")(lambda t: t.texts.select("review_id", F.regexp_count("review_text", L.term_regex(F.lit("that"))).cast("long").alias("n")))


def candidates(t: Tables):
    """Per document: its first words in several shapes, an empty one, a wrong type and an invented name."""
    w = F.regexp_extract_all("review_text", F.lit(r"\p{L}+"), F.lit(0))
    two = F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    c = lambda n, s, k, a=None, b=None: F.struct(
        F.lit(n).cast("bigint").alias("cand_no"), s.alias("surface"), F.lit(k).alias("entity_type"),
        F.lit(a).cast("int").alias("start"), (F.lit(None) if b is None else b).cast("int").alias("end"))
    first = F.get("w", F.lit(0))
    lead = F.regexp_extract("review_text", r"^[^\p{L}]*", 0)
    return t.texts.withColumn("w", w).filter("size(w) >= 4").select("review_id", "review_text", "w").select("review_id", F.explode(F.array(
        c(1, two, "place"), c(2, F.upper(first), "PLACE"), c(3, F.concat_ws("  ", F.get("w", F.lit(2)), F.get("w", F.lit(3))), "FOOD"), c(4, F.lit(" "), "PLACE"),
        c(5, first, "SNACK"), c(6, F.lit("zzqqxx"), "PLACE"), c(7, first, "TIP", 0, F.length(first)), c(8, first, "TIP", 0, F.length(first)), c(9, first, "TIP", 5, F.lit(2)))).alias("c")).select(
        "review_id", "c.*").withColumn("confidence", F.lit(None).cast("double"))


def grounded(t: Tables):
    return mentions.ground(candidates(t), t.texts)


query("men_6_ground")(grounded)
query("men_6_drop_reasons", """
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\p{L}+') AS w FROM documents), d AS (SELECT *, w[1] AS f FROM w WHERE len(w) >= 4)
SELECT 'empty-surface' AS drop_reason, count(*) AS n FROM d UNION ALL SELECT 'unknown-type:SNACK', count(*) FROM d UNION ALL SELECT 'not-in-source', count(*) FROM d WHERE NOT contains(lower(text), 'zzqqxx')
UNION ALL SELECT 'offsets-out-of-range', count(*) FROM d
""")(lambda t: grounded(t).filter("cand_no IN (4, 5, 6, 9)").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")))
query("men_7_grounding_report")(lambda t: mentions.grounding_report(grounded(t)))
query("men_8_sentences", f"""WITH {SPANS_SQL}, s AS (SELECT k.review_id, k.name, k.start, k."end", substr(text, 1, start + 1) AS head, substr(text, "end" + 1) AS tail, text FROM kept_spans k JOIN documents ON doc_id = k.review_id),
b AS (SELECT *, length(regexp_extract(head, '(?s)^(.*[.!?\\x{{0964}}\\n])', 1)) AS l FROM s)
SELECT review_id, CAST(start AS INTEGER) AS start, {squeeze_sql('''concat(substr(text, l + 1, "end" - l), regexp_extract(tail, '^[^.!?\\x{0964}\\n]*[.!?\\x{0964}\\n]?'))''')} AS sentence FROM b
""")(lambda t: place_mentions(t).join(t.texts.select("review_id", "review_text"), "review_id").select(
    "review_id", "start", mentions.sentence(F.col("review_text"), F.col("start"), F.col("end")).alias("sentence")))
query("men_9_generic_guard", """
SELECT conv_id, turn, text FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' The  Beach.' WHEN 1 THEN 'hotel!' ELSE text END AS text FROM conversations) WHERE text NOT IN (' The  Beach.', 'hotel!')
  AND trim(text) <> '' AND regexp_matches(text, '[^.,;:!?\\s]')
""")(lambda t: mentions.drop_generic(t.raw("conversations").selectExpr(
    "conv_id", "turn", "CASE turn % 3 WHEN 0 THEN ' The  Beach.' WHEN 1 THEN 'hotel!' ELSE text END AS surface")).withColumnRenamed("surface", "text"))
query("men_10_concept_table", """
SELECT concept, entity_type, count(DISTINCT review_id) AS n_reviews, count(*) AS n_mentions, count(DISTINCT surface) AS n_spellings FROM (SELECT m.*, l.concept FROM mentions m JOIN (
  SELECT DISTINCT lower(concat(p_name, ' ', p_brand)) AS k, p_name AS concept FROM part) l ON l.k = lower(m.surface) WHERE entity_type = 'FOOD') GROUP BY 1, 2
""")(lambda t: mentions.concept_table(t.mentions, t.raw("part").selectExpr("concat(p_name, ' ', p_brand) AS surface", "'food' AS entity_type", "p_name AS concept")))


# ---- pairs -------------------------------------------------------------------------------------------
def groups(t: Tables):
    """Surfaces of the star's mentions, with part names as official names of some places."""
    lex = t.raw("part").filter("p_size = 7 AND p_type = 'STANDARD'").selectExpr("concat(p_name, ' ', p_brand) AS surface", "'FOOD' AS entity_type", "'accept' AS decision", "p_name AS concept")
    none = t.raw("region").limit(0)
    eq = resolution.equivalents(lex, none.selectExpr("r_name AS bangla", "r_name AS place", "r_name AS decision"), none.selectExpr("r_name AS variant", "r_name AS place", "r_name AS decision"))
    official = t.raw("part").filter("p_type = 'LARGE'").selectExpr("concat(initcap(p_name), ' ', p_brand, ' Beach') AS place_name", "concat('NATION_', p_size % 25) AS district", "CAST(NULL AS string) AS division").distinct()
    return resolution.surface_groups(t.mentions, t.host_reviews, official, eq)


query("res_1_equivalents", """
SELECT 'FOOD' AS entity_type, lower(concat(p_name, ' ', p_brand)) AS key, max(p_name) AS target FROM part WHERE p_size < 20 GROUP BY 1, 2
UNION ALL SELECT 'PLACE', lower(p_name), max(p_brand) FROM part WHERE p_size >= 40 GROUP BY 1, 2
""")(lambda t: resolution.equivalents(
    t.raw("part").selectExpr("concat(p_name, '  ', p_brand) AS surface", "'food' AS entity_type", "CASE WHEN p_size < 20 THEN 'accept ' ELSE 'reject' END AS decision", "p_name AS concept"),
    t.raw("part").selectExpr("upper(p_name) AS bangla", "p_brand AS place", "CASE WHEN p_size >= 40 THEN 'accept' ELSE 'pending' END AS decision"),
    t.raw("part").filter("p_size < 0").selectExpr("p_name AS variant", "p_brand AS place", "'accept' AS decision")))
query("res_2_surface_groups", """
SELECT coalesce(m.surface, o.surface) AS surface, coalesce(m.entity_type, 'PLACE') AS entity_type, coalesce(m.mentions, 0) AS mentions, coalesce(m.n_reviews, 0) AS n_reviews,
  list_sort(list_distinct(coalesce(m.districts, []::VARCHAR[]) || coalesce(o.districts, []::VARCHAR[]))) AS districts, coalesce(m.divisions, []::VARCHAR[]) AS divisions, coalesce(m.languages, []::VARCHAR[]) AS languages
FROM (SELECT surface, min(entity_type) AS entity_type, count(*) AS mentions, count(DISTINCT m.review_id) AS n_reviews, list_sort(list(DISTINCT district)) AS districts, list_sort(list(DISTINCT division)) AS divisions,
  list_sort(list(DISTINCT language)) AS languages FROM mentions m LEFT JOIN host_reviews h ON h.review_id = m.review_id GROUP BY 1) m
FULL JOIN (SELECT concat(upper(p_name[1]), p_name[2:instr(p_name, ' ')], upper(p_name[instr(p_name, ' ') + 1]), p_name[instr(p_name, ' ') + 2:], ' ', p_brand, ' Beach') AS surface,
  list_sort(list(DISTINCT concat('NATION_', p_size % 25))) AS districts FROM part WHERE p_type = 'LARGE' GROUP BY 1) o ON o.surface = m.surface
""")(lambda t: groups(t).select("surface", "entity_type", "mentions", "n_reviews", "districts", "divisions", "languages"))


def resolved(t: Tables):
    g = cut_lineage(groups(t))
    clusters = resolution.resolve(g)
    registry = t.raw("part").filter("p_partkey % 3 = 0").selectExpr("concat(p_name, ' ', p_brand) AS surface", "concat('E', lpad(p_partkey, 4, '0')) AS entity_id").groupBy("surface").agg(F.min("entity_id").alias("entity_id"))
    return g, clusters, registry


query("res_3_clusters")(lambda t: resolution.resolve(groups(t)))
def surface_vectors(t: Tables):
    """A vector for two of three surfaces, the same one for spellings that differ in case."""
    v = t.raw("embeddings").select("vec_id", "embedding")
    n = v.agg(F.max("vec_id") + 1).scalar()
    at = groups(t).select("surface", F.pmod(F.crc32(F.lower("surface").cast("binary")), n).alias("vec_id")).filter("vec_id % 3 > 0")
    return at.join(v, "vec_id").select("surface", "embedding")


query("res_3_clusters_with_vectors")(lambda t: resolution.resolve_with_vectors(groups(t), surface_vectors(t)))
query("res_3_case_variants_share_a_cluster", """
WITH s AS (SELECT surface, min(entity_type) AS kind FROM mentions GROUP BY 1), d AS (SELECT DISTINCT m.surface, h.division FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id)
SELECT DISTINCT lower(surface) AS spelling, 1 AS n_clusters FROM s JOIN d USING (surface) WHERE kind = 'PLACE' GROUP BY lower(surface), division HAVING count(DISTINCT surface) > 1
""")(lambda t: _case_variants(t))


def _case_variants(t: Tables):
    g, c, _ = resolved(t)
    j = c.join(g.filter("entity_type = 'PLACE' AND mentions > 0").select("surface", "divisions"), "surface").withColumn("spelling", F.lower("surface"))
    shared = j.select("spelling", "surface", F.explode("divisions").alias("d")).groupBy("spelling", "d").agg(F.count_distinct("surface").alias("k")).filter("k > 1").select("spelling").distinct()
    return j.join(shared, "spelling").groupBy("spelling").agg(F.count_distinct("root").cast("int").alias("n_clusters"))


def ids(t: Tables):
    g, c, r = resolved(t)
    return resolution.assign_ids(c, r)


query("res_4_stable_ids")(ids)
query("res_4_retired_ids")(lambda t: (lambda g, c, r: resolution.retired_ids(c, r, resolution.assign_ids(c, r)))(*resolved(t)))
query("res_5_entities")(lambda t: (lambda g, c, r: resolution.entity_tables(g, c, resolution.assign_ids(c, r), t.mentions)[0])(*resolved(t)))
query("res_5_variants")(lambda t: (lambda g, c, r: resolution.entity_tables(g, c, resolution.assign_ids(c, r), t.mentions)[1])(*resolved(t)))
query("res_6_bcubed", """
WITH i AS (SELECT p_partkey AS item, p_brand AS c, p_type AS l FROM part), n AS (SELECT c, l, count(*) AS n FROM i GROUP BY 1, 2), cc AS (SELECT c, sum(n) AS t, max(n) AS b FROM n GROUP BY 1), ll AS (SELECT l, sum(n) AS t FROM n GROUP BY 1),
s AS (SELECT sum(n * n / cc.t) / sum(n) AS p, sum(n * n / ll.t) / sum(n) AS r, CAST(sum(n) AS BIGINT) AS k FROM n JOIN cc USING (c) JOIN ll USING (l))
SELECT k AS n_items, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, round((SELECT sum(b) FROM cc) / k, 4) AS purity FROM s
""")(lambda t: resolution.bcubed(t.raw("part").selectExpr("p_partkey AS item", "p_brand AS cluster"), t.raw("part").selectExpr("p_partkey AS item", "p_type AS label")))


def scored_pairs(t: Tables):
    """Pairs of surfaces whose sound keys share their tokens, one inside the other."""
    g = groups(t).filter("entity_type = 'PLACE'")
    keyed = g.select(F.col("surface").alias("id"), F.col("key_tokens").alias("tokens"))
    pairs = joins.token_subset_pairs(keyed, keyed).filter("id <> rid").select("id", "rid")
    cols = ["normalized", "key_tokens", "name_tokens", "bengali", "districts", "divisions"]
    a = g.select(F.col("surface").alias("id"), F.struct(*cols).alias("a"))
    b = g.select(F.col("surface").alias("rid"), F.struct(*cols).alias("b"))
    return joins.pair_signals(pairs.join(a, "id").join(b, "rid"))


query("join_9_fuzzy_ratio")(lambda t: scored_pairs(t).select("id", "rid", F.round(fuzzy_ratio("a.normalized", "b.normalized"), 4).alias("ratio")))
query("join_10_pair_scores")(lambda t: scored_pairs(t).select("id", "rid", "phonetic", "string", "containment", "geography", F.round("score", 4).alias("score")))
query("join_11_subset_candidates", """
WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT p_partkey AS rid, string_split(concat(p_name, ' ', lower(p_type)), ' ') AS b FROM part), l AS (SELECT p_name AS id, list_distinct(string_split(p_name, ' ')) AS a FROM n)
SELECT id, rid FROM l JOIN p ON list_has_all(b, a)
""")(lambda t: joins.token_subset_pairs(
    t.raw("part").select(F.col("p_name").alias("id"), F.array_distinct(F.split("p_name", " ")).alias("tokens")).distinct(),
    t.raw("part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.expr("concat(p_name, ' ', lower(p_type))"), " ")).alias("tokens"))))


def misspelled(t: Tables):
    return t.raw("supplier").selectExpr("concat(substring(s_name, 1, 6), substring(s_name, 8), CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END) AS name")


query("join_12_spelling_proposals")(lambda t: joins.spelling_proposals(
    misspelled(t), t.raw("supplier").selectExpr("s_name AS place"), misspelled(t).filter("name LIKE '%5'").withColumnRenamed("name", "variant")))


def listed_points(t: Tables):
    # Powers of a key are taken modulo step by step: a key of 2.1 million cubed is beyond a long.
    return t.raw("customer").selectExpr(
        "c_custkey AS place_id", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name", "22 + CAST((c_custkey % 3100) * (c_custkey % 3100) * 37 % 3100 AS double) / 10000 AS lat",
        "90 + CAST((c_custkey % 2350) * (c_custkey % 2350) * (c_custkey % 2350) % 2350 AS double) / 10000 AS lng", "c_custkey % 500 * 13 % 500 AS review_count")


NEAR_SQL = """pts AS MATERIALIZED (SELECT c_custkey AS place_id, radians(22 + (c_custkey * c_custkey * 37 % 3100)::DOUBLE / 10000) AS lat, radians(90 + (c_custkey * c_custkey * c_custkey % 2350)::DOUBLE / 10000) AS lng FROM customer),
near AS (SELECT a.place_id AS a_place_id, b.place_id AS b_place_id, 2 * 6371000.0 * asin(sqrt(pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lng - a.lng) / 2), 2))) AS metres
  FROM pts a JOIN pts b ON a.place_id < b.place_id AND abs(a.lat - b.lat) < 0.0001)"""
query("join_13_nearby_places", f"WITH {NEAR_SQL} SELECT a_place_id, b_place_id, round(metres, 3) AS metres FROM near WHERE metres <= 400")(
    lambda t: joins.nearby_places(listed_points(t)).select("a_place_id", "b_place_id", F.round("metres", 3).alias("metres")))
query("join_13_close_duplicates")(lambda t: joins.close_duplicates(listed_points(t)))


def listed(t: Tables):
    return t.places.selectExpr("concat('id', place_id) AS place_id", "concat(' ', upper(place_name)) AS name", "array(concat('old', place_id)) AS other_place_ids")


def existing(t: Tables):
    return t.raw("customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat('supplier#', lpad(c_custkey % 40, 9, '0')) END AS place_name").distinct()


query("join_14_match_existing", """
WITH e AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat('supplier#', lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0')) END AS place_name FROM customer),
a AS (SELECT lower(c_name) AS k, concat('id', c_custkey % 5) AS pid FROM customer WHERE c_custkey % 12 = 0 UNION ALL SELECT lower(s_name), 'id1' FROM supplier WHERE s_suppkey = 2)
SELECT place_name, coalesce(a.pid, 'id' || s_suppkey) AS place_id, CASE WHEN a.pid IS NOT NULL THEN 'alias' WHEN s_suppkey IS NOT NULL THEN 'same name' ELSE 'unmatched' END AS basis, coalesce(a.pid <> 'id' || s_suppkey, false) AS ambiguous
FROM e LEFT JOIN a ON a.k = lower(place_name) LEFT JOIN supplier ON lower(s_name) = lower(place_name)
""")(lambda t: joins.match_existing(existing(t), listed(t), t.raw("customer").filter("c_custkey % 12 = 0").selectExpr("c_name AS alias", "concat('old', c_custkey % 5) AS place_id").unionByName(
    t.raw("supplier").filter("s_suppkey = 2").selectExpr("s_name AS alias", "'id1' AS place_id"))))
query("join_14_name_suggestions")(lambda t: alike.name_suggestions(existing(t), t.raw("supplier").selectExpr("s_name AS name")))
query("join_15_gazetteer_match", """
WITH e AS (SELECT s_suppkey, concat('E', s_suppkey) AS entity_id FROM supplier)
SELECT entity_id, s_name AS maps_place, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS maps_review_count FROM e JOIN supplier USING (s_suppkey) WHERE s_suppkey % 4 <> 3
""")(lambda t: joins.gazetteer_match(
    t.raw("supplier").selectExpr("concat('E', s_suppkey) AS entity_id", "CASE s_suppkey % 4 WHEN 0 THEN concat('The ', upper(s_name), ' Sea Beach') WHEN 1 THEN concat('misspelt ', s_suppkey) ELSE concat('nothing ', s_suppkey) END AS canonical_name"),
    t.raw("supplier").filter("s_suppkey % 4 = 2").selectExpr("concat('E', s_suppkey) AS entity_id", "concat('inner ', s_suppkey) AS surface", "3L AS mentions"),
    t.raw("supplier").selectExpr("s_name AS canonical_name", "concat('Old ', s_name, ' (inner ', s_suppkey, ')') AS list_name", "CAST(NULL AS array<string>) AS aliases",
                                 "CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS reviews", "s_suppkey AS list_order"),
    t.raw("supplier").filter("s_suppkey % 4 = 1").selectExpr("concat('Misspelt ', s_suppkey) AS variant", "s_name AS place", "'accept' AS decision")))


# ---- two versions of a review ---------------------------------------------------------------------------
def concept_sides(t: Tables):
    """Concepts of two versions: a review's mentions in upper case stand for the original."""
    m = t.mentions.selectExpr("review_id", "entity_type", "lower(surface) AS concept", "surface", "surface = upper(surface) AS original", "length(sentence) > 60 AS secondary")
    return m.filter("original").drop("original"), m.filter("NOT original").drop("original")


def compared(t: Tables):
    o, tr = concept_sides(t)
    words = tr.groupBy("review_id").agg(F.sort_array(F.collect_set("concept")).alias("c")).select("review_id", F.split(F.array_join("c", " "), " ").alias("words"))
    return joins.translation_compare(o, tr, words)


query("join_16_translation_compare")(compared)
query("join_16_versions_side_by_side", """
WITH m AS (SELECT review_id, entity_type, lower(surface) AS concept, surface, surface = upper(surface) AS o FROM mentions)
SELECT review_id, entity_type, concept, bool_or(o) AS in_original, bool_or(NOT o) AS in_translation, coalesce(min(CASE WHEN o THEN surface END), '') AS original_surface, coalesce(min(CASE WHEN NOT o THEN surface END), '') AS translation_surface FROM m GROUP BY 1, 2, 3
""")(lambda t: compared(t).select("review_id", "entity_type", "concept", "in_original", "in_translation", "original_surface", "translation_surface"))
query("join_18_translation_pairs", f"""WITH {BANGLA_TEXTS}, c AS (SELECT review_id, len(regexp_extract_all(review_text, '[\\x{{0980}}-\\x{{09ff}}]')) AS b, len(regexp_extract_all(review_text, '[A-Za-z]')) AS l, lang, review_text, text FROM bangla_texts JOIN documents ON doc_id = review_id)
SELECT review_id, CASE WHEN b / (b + l) > 0.8 THEN 'bangla' ELSE 'banglish' END AS script FROM c WHERE lang = 'en' AND {squeeze_sql('review_text')} <> {squeeze_sql("concat(text, '.')")} AND b + l > 0 AND (b::DOUBLE / (b + l) > 0.8 OR l::DOUBLE / (b + l) > 0.8)
""")(lambda t: joins.translation_pairs(bangla_texts(t).selectExpr("review_id", "review_text AS review_text_original", "CASE WHEN review_language = 'en' THEN 'bn' END AS original_language").join(
    t.texts.selectExpr("review_id", "concat(review_text, '.') AS review_text_clean"), "review_id")).select("review_id", "script"))


# ---- mined spellings --------------------------------------------------------------------------------------
def known_places(t: Tables):
    """Long words of the benchmark, as names whose Bangla spelling is looked for."""
    w = t.raw("benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("name")).distinct()
    return w.filter("length(name) >= 7")


query("lng_11_mine_spellings")(lambda t: mining.mine_spellings(bangla_texts(t), known_places(t)))
query("lng_12_mine_aligned")(lambda t: mining.count_phrases(mining.mine_aligned(
    bangla_texts(t).selectExpr("review_id", "review_text AS original").join(t.texts.selectExpr("review_id", "review_text AS translation"), "review_id"), known_places(t)), bangla_texts(t)))
