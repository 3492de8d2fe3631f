"""Import, cleaning, duplicates, names, validation and language labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions import language as L
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.operators import prep, rollups
from roamlens.plans.registry import query
from roamlens.plans.serving import stats
from roamlens.sources import batches, sinks
from roamlens.sources.adapters import Tables

WS, CONTROL = T.WS, T.CONTROL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "),
            ("&eacute;", "é"), ("&copy;", "©"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]


def unescape_sql(x: str) -> str:
    for name, char in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def clean_sql(x: str) -> str:
    body = f"regexp_replace({unescape_sql(x)}, {q(f'^{WS}*(?:Liked|Disliked):{WS}*')}, '')"
    label = WS + r"*\|" + WS + "*(?:Liked|Disliked):" + WS + "*"
    return squeeze_sql(f"regexp_replace({body}, {q(label)}, '. ', 'g')")


def submission_sql(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, {q(CONTROL)}, '', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(x)


# ---- cleaning -----------------------------------------------------------------------------
def labelled_texts(t: Tables):
    """Documents with the form labels and entities that exports carry."""
    return t.texts.withColumn("row_order", F.col("review_id")).withColumn("review_text", F.expr(
        "CASE WHEN review_id % 3 = 0 THEN concat(' Liked: ', review_text, ' | Disliked: caf&eacute; &amp; bar') ELSE review_text END"))


LABELLED = """labelled AS MATERIALIZED (SELECT doc_id AS review_id, source, source AS place_name, lang AS review_language,
  CASE WHEN doc_id % 3 = 0 THEN concat(' Liked: ', text, ' | Disliked: caf&eacute; &amp; bar') ELSE text END AS review_text FROM documents)"""
CLEANED = f"{LABELLED}, cleaned AS MATERIALIZED (SELECT *, {clean_sql('review_text')} AS review_text_clean FROM labelled)"

query("pre_1_clean_text", f"WITH {CLEANED} SELECT review_id, review_text_clean FROM cleaned")(
    lambda t: prep.clean(labelled_texts(t)).select("review_id", "review_text_clean"))
query("pre_2_clean_markup", f"SELECT page_id, {submission_sql('html')} AS body FROM pages")(
    lambda t: t.raw("pages").select("page_id", T.clean_submission(F.col("html")).alias("body")))
query("pre_3_drop_short", f"WITH {CLEANED} SELECT review_id, length(review_text_clean) AS n FROM cleaned WHERE length(review_text_clean) >= 10")(
    lambda t: prep.drop_short(prep.clean(labelled_texts(t))).select("review_id", F.length("review_text_clean").cast("long").alias("n")))
query("pre_4_first_by_id", """
SELECT review_id, l_partkey, l_suppkey, l_quantity FROM (SELECT concat(l_orderkey, '-', l_linenumber) AS review_id, l_partkey, l_suppkey, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")(lambda t: prep.first_per_key(
    t.raw("lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS review_id", "l_partkey", "l_suppkey", "l_quantity"),
    ["review_id"], F.struct("l_partkey", "l_suppkey")))
query("pre_5_first_by_text", f"""WITH {CLEANED}
SELECT review_id, source FROM (SELECT *, row_number() OVER (PARTITION BY review_text_clean ORDER BY review_id) AS rn FROM cleaned) WHERE rn = 1
""")(lambda t: prep.first_by_text(prep.clean(labelled_texts(t))).select("review_id", "source"))
query("pre_6_content_id", """
SELECT doc_id AS review_id, substr(md5(concat_ws('|', source, source, text, '')), 1, 16) AS content_id FROM documents
""")(lambda t: t.texts.select("review_id", T.content_id(F.col("source"), F.col("place_name"), F.col("review_text"), F.lit(None)).alias("content_id")))
query("pre_7_new_rows", """
SELECT doc_id AS review_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")(lambda t: prep.new_rows(t.texts, t.raw("labels").withColumnRenamed("doc_id", "review_id")).select("review_id", "source"))
query("pre_14_preprocess_stats", f"""WITH {CLEANED}, texts_once AS (SELECT review_text_clean, count(*) AS c, length(any_value(review_text_clean)) AS n FROM cleaned GROUP BY 1)
SELECT 'rows_in' AS metric, (SELECT count(*) FROM cleaned) AS value UNION ALL SELECT 'rows_out', count(*) FILTER (n >= 10) FROM texts_once
UNION ALL SELECT 'dropped_duplicate_id', 0 UNION ALL SELECT 'dropped_too_short', CAST(coalesce(sum(c) FILTER (n < 10), 0) AS BIGINT) FROM texts_once
UNION ALL SELECT 'dropped_duplicate_text', CAST(coalesce(sum(c - 1) FILTER (n >= 10), 0) AS BIGINT) FROM texts_once
""")(lambda t: prep.preprocess_stats(labelled_texts(t)))
query("pre_12_coarse_language", f"""WITH {CLEANED}
SELECT review_id, CASE WHEN regexp_matches(review_text_clean, '[\\x{{980}}-\\x{{9ff}}]') THEN CASE WHEN regexp_matches(review_text_clean, '[A-Za-z]') THEN 'bn-en-mixed' ELSE 'bn' END
  WHEN length(review_text_clean) < 50 AND regexp_matches(review_text_clean, '[A-Za-z]') THEN 'en' ELSE review_language END AS detected_language FROM cleaned
""")(lambda t: prep.clean(labelled_texts(t)).select(
    "review_id", L.coarse_language(F.col("review_text_clean"), F.col("review_language")).alias("detected_language")))
query("pre_16_text_fingerprint", f"SELECT doc_id AS review_id, sha256(lower({squeeze_sql('text')})) AS fingerprint FROM documents")(
    lambda t: t.texts.select("review_id", T.fingerprint(F.col("review_text")).alias("fingerprint")))
query("pre_16_repeated_texts", f"""
SELECT conv_id * 1000 + turn AS submission_id FROM conversations c WHERE role = 'user' AND sha256(lower({squeeze_sql('text')})) IN (
  SELECT sha256(lower({squeeze_sql('text')})) FROM conversations WHERE role = 'assistant')
UNION ALL SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower({squeeze_sql('text')}))) AS first_id FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_id
""")(lambda t: prep.repeated_texts(
    t.raw("conversations").filter("role = 'user'").selectExpr("conv_id * 1000 + turn AS submission_id", "text AS review_text"),
    t.raw("conversations").filter("role = 'assistant'").selectExpr("text AS review_text")).select("submission_id").unionByName(
    prep.repeats(t.texts.withColumnRenamed("review_id", "submission_id")).select("submission_id")))


# ---- names and places -----------------------------------------------------------------------
def registry(t: Tables):
    return t.places.selectExpr(
        "place_id AS list_order", "concat('ref-', place_id) AS place_ref", "place_name AS canonical_name",
        "concat('The ', place_name) AS list_name", "array(concat(place_name, ' (', district, ')')) AS aliases",
        "array(concat('alt-', place_id)) AS other_refs", "city", "district", "division", "lat", "lng")


def named_reviews(t: Tables):
    """Line items whose supplier is named in one of several spellings, some with an id."""
    return t.raw("lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id",
        "CASE l_linenumber % 4 WHEN 0 THEN upper(concat('Supplier#', lpad(l_suppkey, 9, '0'))) "
        "WHEN 1 THEN concat('the  Supplier#', lpad(l_suppkey, 9, '0')) WHEN 2 THEN concat('Shop ', l_suppkey) "
        "ELSE concat('Supplier#', lpad(l_suppkey, 9, '0')) END AS place_name",
        "CASE WHEN l_linenumber % 3 = 0 THEN concat('alt-', l_suppkey) END AS place_ref",
        "CASE WHEN l_returnflag = 'A' THEN 23.5D END AS lat", "CASE WHEN l_returnflag <> 'R' THEN 90.5D END AS lng")


NAMED = """named_rows AS MATERIALIZED (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN upper(concat('Supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')))
  WHEN 1 THEN concat('the  Supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) WHEN 2 THEN concat('Shop ', l_suppkey)
  ELSE concat('Supplier#', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) END AS old_name,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('alt-', l_suppkey) END AS place_ref,
  CASE WHEN l_returnflag = 'A' THEN 23.5::DOUBLE END AS lat, CASE WHEN l_returnflag <> 'R' THEN 90.5::DOUBLE END AS lng FROM lineitem),
final_rows AS MATERIALIZED (SELECT n.*, CASE WHEN place_ref IS NOT NULL OR old_name NOT LIKE 'Shop%' THEN s_name ELSE old_name END AS place_name
  FROM named_rows n JOIN supplier ON l_suppkey = s_suppkey)"""
query("pre_8_canonical_names", f"WITH {NAMED} SELECT review_id, old_name, place_name FROM final_rows")(
    lambda t: prep.canonical_names(named_reviews(t), registry(t)).select("review_id", "old_name", "place_name"))
query("pre_8_renames", f"WITH {NAMED} SELECT DISTINCT old_name, place_name FROM final_rows WHERE old_name <> place_name")(
    lambda t: prep.renames(prep.canonical_names(named_reviews(t), registry(t))))
query("pre_9_fill_coordinates", f"""WITH {NAMED}
SELECT f.review_id, CASE WHEN (f.lat IS NULL OR f.lng IS NULL) AND p.lat IS NOT NULL THEN p.lat ELSE f.lat END AS lat,
  CASE WHEN (f.lat IS NULL OR f.lng IS NULL) AND p.lat IS NOT NULL THEN p.lng ELSE f.lng END AS lng
FROM final_rows f LEFT JOIN places p ON p.place_name = f.place_name
""")(lambda t: prep.fill_coordinates(prep.canonical_names(named_reviews(t), registry(t)), registry(t)).select("review_id", "lat", "lng"))
query("pre_10_coordinate_in_box", """
SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 5 = 0 THEN false ELSE 19 + s_suppkey % 10 BETWEEN 20.5 AND 26.7 AND 87 + s_suppkey % 7 BETWEEN 88.0 AND 92.7 END AS usable FROM supplier
""")(lambda t: t.raw("supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 5 > 0 THEN 19 + s_suppkey % 10 END AS a", "87 + s_suppkey % 7 AS b").select(
    F.col("s_suppkey").alias("place_id"), prep.S.in_box(F.col("a"), F.col("b")).alias("usable")))


def overrides(t: Tables):
    return t.raw("labels").selectExpr("CASE WHEN doc_id % 50 = 0 THEN -doc_id - 1 ELSE doc_id END AS review_id",
                                      "CASE WHEN quality = 1 THEN 'bn' WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS label")


OVERRIDES = "overrides AS (SELECT CASE WHEN doc_id % 50 = 0 THEN -doc_id - 1 ELSE doc_id END AS review_id, CASE WHEN quality = 1 THEN 'bn' WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS label FROM labels)"
LABELS = ["bn", "bn-en-mixed", "en"]
query("pre_11_overrides", f"""WITH {OVERRIDES}
SELECT d.doc_id AS review_id, coalesce(o.label, d.lang) AS detected_language FROM documents d
LEFT JOIN (SELECT review_id, label FROM overrides WHERE label IN ('bn', 'bn-en-mixed', 'en')) o ON o.review_id = d.doc_id
""")(lambda t: prep.apply_overrides(t.texts.withColumn("detected_language", F.col("review_language")), overrides(t), LABELS).select("review_id", "detected_language"))
query("pre_11_override_problems", f"""WITH {OVERRIDES}
SELECT review_id, 'unknown label' AS problem FROM overrides WHERE label NOT IN ('bn', 'bn-en-mixed', 'en')
UNION ALL SELECT review_id, 'unknown review' FROM overrides WHERE review_id NOT IN (SELECT doc_id FROM documents)
""")(lambda t: prep.override_problems(t.texts, overrides(t), LABELS))
query("pre_13_downstream_gaps", """
SELECT 'reviews_without_topic' AS gap, count(*) AS value FROM reviews WHERE topic_id IS NULL
UNION ALL SELECT 'places_without_geography', count(*) FROM (SELECT DISTINCT place_id FROM reviews JOIN places USING (place_id) WHERE city IS NULL AND lat IS NULL)
UNION ALL SELECT 'ratings_over_5', count(*) FROM reviews WHERE review_rating > 5
""")(lambda t: prep.downstream_gaps(
    t.reviews.join(t.places.select("place_id", "place_name", "city"), "place_id"), t.reviews.filter("topic_id IS NOT NULL"),
    t.places.filter("lat IS NOT NULL")))


def submissions(t: Tables):
    return t.raw("conversations").filter("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS submission_id", "text AS review_text", "CAST(turn % 7 AS int) AS rating",
        "CASE WHEN conv_id % 2 = 0 THEN concat('<b>supplier#', lpad(conv_id % 12, 9, '0'), '</b>') ELSE concat('New spot ', conv_id) END AS place_name",
        "conv_id % 3 = 0 AS is_new_place", "CASE WHEN conv_id % 9 = 0 THEN 'x' ELSE 'Somewhere' END AS district")


query("pre_15_validate_submissions", f"""WITH s AS (SELECT conv_id * 1000 + turn AS submission_id, {submission_sql('text')} AS body, turn % 7 AS rating,
  {submission_sql("CASE WHEN conv_id % 2 = 0 THEN concat('<b>supplier#', lpad(CAST(conv_id % 12 AS VARCHAR), 9, '0'), '</b>') ELSE concat('New spot ', conv_id) END")} AS named,
  conv_id % 3 = 0 AS is_new, CASE WHEN conv_id % 9 = 0 THEN 'x' ELSE 'Somewhere' END AS area FROM conversations WHERE role = 'user')
SELECT submission_id, coalesce(s_name, named) AS place_name, s_name IS NULL AND is_new AS is_new_place, CAST(length(body) AS INTEGER) AS n_chars,
  CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating' WHEN length(body) < 30 THEN 'too-short' WHEN length(body) > 3000 THEN 'too-long'
  WHEN len(regexp_extract_all(body, '(?i)(?:https?://|www[.])')) > 1 THEN 'links' WHEN len(list_distinct(string_split(replace(body, ' ', ''), ''))) < 6 THEN 'not-a-review'
  WHEN s_name IS NOT NULL THEN 'accepted' WHEN NOT is_new THEN 'unknown-place' WHEN length(named) NOT BETWEEN 3 AND 120 THEN 'place-name'
  WHEN length(area) NOT BETWEEN 2 AND 60 THEN 'district' ELSE 'accepted' END AS outcome
FROM s LEFT JOIN supplier ON lower(s_name) = lower(named)
""")(lambda t: prep.validate_submissions(submissions(t), t.places))
query("pre_17_corpus_health", """
SELECT d.division, coalesce(p, 0) AS places, coalesce(r, 0) AS reviews, coalesce(th, 0) AS thin_places,
  CASE WHEN coalesce(p, 0) < 1 THEN 'too few places' WHEN th > 0 THEN 'thin places' ELSE 'ok' END AS verdict
FROM (SELECT r_name AS division FROM region UNION ALL SELECT 'NOWHERE') d LEFT JOIN
 (SELECT division, count(*) AS p, CAST(sum(n) AS BIGINT) AS r, count(*) FILTER (n < 600) AS th FROM (SELECT place_id, count(*) AS n FROM reviews GROUP BY 1) JOIN places USING (place_id) GROUP BY 1) g ON g.division = d.division
""")(lambda t: prep.corpus_health(t.reviews, t.places, t.raw("region").selectExpr("r_name AS division").unionByName(
    t.raw("region").limit(1).selectExpr("'NOWHERE' AS division")), min_place_reviews=600))
query("pre_17_duplicate_ids", """
SELECT concat(l_orderkey, '-', l_linenumber) AS review_id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1
""")(lambda t: prep.duplicate_ids(t.raw("lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS review_id")))


def place_rows(t: Tables):
    return t.places.selectExpr(
        "place_id AS row_order", "concat('id', place_id div 2 * 2 + place_id % 3 div 2) AS place_id",
        "CASE WHEN place_id % 11 = 0 THEN '' ELSE place_name END AS name", "division",
        "CASE WHEN place_id % 2 = 0 THEN concat(' ', district, ' (Town ', place_id, ') ') ELSE district END AS district",
        "CASE WHEN place_id % 7 = 0 THEN 'n/a' ELSE CAST(22 + place_id % 4 AS string) END AS latitude",
        "CASE WHEN place_id % 5 = 0 THEN '12.5' ELSE CAST(89 + place_id % 3 AS string) END AS longitude")


query("pre_18_validate_place_list", """
WITH r AS (SELECT place_id AS row_order, concat('id', place_id // 2 * 2 + place_id % 3 // 2) AS pid, CASE WHEN place_id % 11 = 0 THEN '' ELSE place_name END AS name, division,
  trim(CASE WHEN place_id % 2 = 0 THEN concat(' ', district, ' (Town ', place_id, ') ') ELSE district END) AS district,
  CASE WHEN place_id % 7 = 0 THEN NULL ELSE 22 + place_id % 4 END AS lat, CASE WHEN place_id % 5 = 0 THEN 12.5 ELSE 89 + place_id % 3 END AS lng FROM places)
SELECT pid AS place_id, name, row_order, CASE WHEN division NOT IN ('ASIA', 'EUROPE', 'AFRICA', 'AMERICA') THEN 'unknown division' WHEN name = '' THEN 'blank name or id' WHEN lat IS NULL THEN 'not a number'
  WHEN NOT (lat BETWEEN 20.5 AND 26.7 AND lng BETWEEN 88.0 AND 92.7) THEN 'outside' WHEN row_order <> min(row_order) OVER (PARTITION BY pid) THEN 'repeated' ELSE 'ok' END AS outcome,
  CASE WHEN contains(district, '(') THEN trim(split_part(district, '(', 1)) ELSE district END AS district_clean,
  CASE WHEN contains(district, '(') THEN replace(split_part(district, '(', 2), ')', '') ELSE district END AS city FROM r
""")(lambda t: prep.validate_place_list(place_rows(t), ["ASIA", "EUROPE", "AFRICA", "AMERICA"]))
query("pre_19_known_names", """
SELECT source AS place_name, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT lang)), '|') AS sources,
  min_by(CASE WHEN n_chars > 500 THEN concat('c', n_chars) END, CASE WHEN n_chars > 500 THEN doc_id END) AS city, min_by(lang, doc_id) AS category FROM documents GROUP BY 1
""")(lambda t: prep.known_names(t.raw("documents").selectExpr(
    "source AS place_name", "lang AS source", "CASE WHEN n_chars > 500 THEN concat('c', n_chars) END AS city", "lang AS category", "doc_id AS row_order")))


def old_geography(t: Tables):
    return t.places.filter("place_id % 4 <> 1").selectExpr(
        "CASE WHEN place_id % 3 = 0 THEN upper(place_name) ELSE place_name END AS place_name", "city",
        "CASE WHEN place_id % 5 = 0 THEN '' ELSE district END AS district", "CASE WHEN place_id % 6 = 0 THEN 'ELSEWHERE' ELSE division END AS division",
        "CAST(1.0D AS double) AS lat", "CAST(2.0D AS double) AS lng")


query("pre_20_upsert_geography", """
SELECT place_name, city, CASE WHEN place_id % 4 <> 1 AND place_id % 5 <> 0 THEN district ELSE district END AS district,
  CASE WHEN place_id % 4 <> 1 AND place_id % 6 = 0 THEN 'ELSEWHERE' ELSE division END AS division,
  CASE WHEN place_id % 4 <> 1 THEN coalesce(lat, 1.0::DOUBLE) ELSE lat END AS lat, CASE WHEN place_id % 4 <> 1 THEN coalesce(lng, 2.0::DOUBLE) ELSE lng END AS lng,
  CASE WHEN place_id % 4 = 1 THEN 'added' WHEN place_id % 3 = 0 THEN 'renamed' ELSE 'updated' END AS change, place_id % 4 <> 1 AND place_id % 6 = 0 AS division_conflict FROM places
""")(lambda t: prep.upsert_geography(old_geography(t), registry(t)))
query("agg_24_final_names", """
WITH n AS (SELECT place_id, concat('The ', place_name) AS name, 2 AS origin FROM places UNION ALL SELECT place_id, place_name, 0 FROM places
  UNION ALL SELECT place_id, concat('Old ', place_name), 1 FROM places WHERE place_id % 2 = 0)
SELECT place_id, final_name, why FROM (SELECT place_id, trim(name) AS final_name, CASE WHEN count(DISTINCT trim(name)) OVER (PARTITION BY place_id) = 1 THEN 'only name' ELSE 'longest of the names' END AS why,
  row_number() OVER (PARTITION BY place_id ORDER BY length(trim(name)) DESC, origin, name) AS rn FROM n) WHERE rn = 1
""")(lambda t: rollups.final_names(t.places.selectExpr("place_id", "concat('The ', place_name) AS name", "2 AS origin").unionByName(
    t.places.selectExpr("place_id", "place_name AS name", "0 AS origin")).unionByName(
    t.places.filter("place_id % 2 = 0").selectExpr("place_id", "concat('Old ', place_name) AS name", "1 AS origin"))))
query("agg_25_name_conflicts", """
SELECT lower(p_name) AS name_key, count(DISTINCT p_partkey) AS n_places, min(p_partkey) AS first_place_id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1
""")(lambda t: rollups.name_conflicts(t.raw("part").selectExpr("p_partkey AS place_id", "p_name AS name")))


# ---- sources and sinks ---------------------------------------------------------------------------
def export_rows(t: Tables):
    return t.raw("documents").selectExpr(
        "source AS title", "n_chars AS stars", "concat('https://x/', doc_id) AS url", "CAST(doc_id AS string) AS reviewId", "lang AS originalLanguage",
        "text", "CASE WHEN doc_id % 2 = 0 THEN concat('In English: ', text) ELSE ' ' END AS textTranslated", "'2024-01-01' AS publishedAtDate", "23.7D AS latitude", "'x' AS unknownField")


query("src_3_conform", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS place_name, CAST(NULL AS VARCHAR) AS city, CAST(n_chars AS DOUBLE) AS review_rating FROM documents
""")(lambda t: batches.conform(t.raw("documents").selectExpr("doc_id AS review_id", "source AS place_name", "n_chars AS review_rating", "lang"), batches.T_.StructType([
    batches.T_.StructField("review_id", batches.T_.StringType()), batches.T_.StructField("place_name", batches.T_.StringType()),
    batches.T_.StructField("city", batches.T_.StringType()), batches.T_.StructField("review_rating", batches.T_.DoubleType())])))
query("src_4_rename_columns", """
SELECT source AS place_name, n_chars AS review_rating, concat('https://x/', doc_id) AS source_url, CAST(doc_id AS VARCHAR) AS review_id, lang AS review_language,
  '2024-01-01' AS review_date, 23.7::DOUBLE AS lat FROM documents
""")(lambda t: batches.rename_columns(export_rows(t)))
query("src_5_resolve_text", f"""
SELECT CAST(doc_id AS VARCHAR) AS "reviewId", CASE WHEN doc_id % 2 = 0 THEN concat('In English: ', text) WHEN {strip_sql('text')} <> '' THEN text END AS review_text,
  CASE WHEN {strip_sql('text')} <> '' THEN text END AS review_text_original, lang AS original_language, lang AS review_language FROM documents
""")(lambda t: batches.resolve_text(export_rows(t)).select("reviewId", "review_text", "review_text_original", "original_language", "review_language"))
query("src_6_provenance", """
SELECT o_orderkey AS review_id, CASE WHEN o_orderstatus = 'F' THEN 'booking' WHEN o_orderstatus = 'O' THEN 'google_maps' ELSE '5-low' END AS source_type,
  CAST(NULL AS VARCHAR) AS collected_at, CAST(NULL AS VARCHAR) AS anchor_place, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END AS discovery_round,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 23.5::DOUBLE END AS lat, CAST(NULL AS DOUBLE) AS lng FROM orders
""")(lambda t: batches.with_provenance(t.raw("orders").selectExpr(
    "o_orderkey AS review_id", "CASE o_orderstatus WHEN 'F' THEN ' Booking.com' WHEN 'O' THEN 'Google Maps' ELSE '5-LOW' END AS source",
    "CASE WHEN o_custkey % 2 = 0 THEN '2' ELSE 'x' END AS discovery_round", "CASE WHEN o_custkey % 3 = 0 THEN '?' ELSE '23.5' END AS lat")).drop("source"))
query("src_7_rescale_rating", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity * 0.5::DOUBLE, 2) AS review_rating, round_even(l_tax * 0.5::DOUBLE, 2) AS place_avg_rating,
  round_even(l_quantity * 0.5::DOUBLE, 2) > 5 AS exceeds_scale FROM lineitem
""")(lambda t: batches.rescale_ratings(t.raw("lineitem").selectExpr(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity AS review_rating", "l_tax AS place_avg_rating"), 10))
query("src_8_to_bool", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN 1 ELSE 0 END AS flag FROM part
""")(lambda t: t.raw("part").selectExpr("p_partkey", "element_at(array(' True', 'NO', 'maybe', 'yes ', ''), CAST(p_size % 5 + 1 AS int)) AS v").select(
    "p_partkey", T.to_bool(F.col("v")).alias("flag")))
query("snk_4_referential_filter", """
SELECT m.topic_id, m.mapping_rank, CASE WHEN preference_id <> 'P-PROMO' THEN preference_id END AS preference_id, similarity FROM topic_map m WHERE topic_id <> 7
""")(lambda t: batches.referential_filter(t.topic_map, t.interpretations, t.preference_classes.filter("preference_id <> 'P-PROMO'")).select(
    "topic_id", "mapping_rank", "preference_id", "similarity"))
query("snk_4_drop_orphan_mentions", """
SELECT mention_id, review_id FROM mentions WHERE review_id IN (SELECT review_id FROM host_reviews WHERE detected_language = 'bn')
""")(lambda t: batches.drop_orphans(t.mentions, t.host_reviews.filter("detected_language = 'bn'")).select("mention_id", "review_id"))
query("snk_3_map_features", """
SELECT 'place' AS layer, CAST(place_id AS VARCHAR) AS feature_id, lng, lat, place_name AS label FROM place_stats WHERE lat IS NOT NULL
UNION ALL SELECT 'gem', entity_id, lng, lat, name FROM lookups WHERE lat IS NOT NULL
""")(lambda t: sinks.features(t.lookups.selectExpr("entity_id", "name AS canonical_name", "'V1' AS visibility", "lat", "lng"), stats(t)).select(
    "layer", "feature_id", F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("lng"),
    F.get_json_object("feature", "$.geometry.coordinates[1]").cast("double").alias("lat"),
    F.coalesce(F.get_json_object("feature", "$.properties.place_name"), F.get_json_object("feature", "$.properties.canonical_name")).alias("label")))
query("snk_3_unmapped", "SELECT entity_id, name AS canonical_name FROM lookups WHERE lat IS NULL")(
    lambda t: sinks.unmapped(t.lookups.withColumnRenamed("name", "canonical_name")))
query("snk_2_smoke_read", """
SELECT 'place_stats' AS view_name, (SELECT count(*) > 0 FROM place_stats) AS has_rows UNION ALL SELECT 'empty', false
""")(lambda t: sinks.smoke_read({"place_stats": stats(t), "empty": t.places.filter("place_id < 0")}))

# ---- language -----------------------------------------------------------------------------------------
BN = r"[\x{0980}-\x{09ff}]"


def bangla_texts(t: Tables):
    """Documents respelled in Bangla letters, in both encodings, for a third of the rows.

    Consonants and vowels are replaced letter by letter, so every text keeps its words; the decomposed
    spellings exercise normalisation. The second third mixes both scripts word by word.
    """
    src, dst = "abcdefghijklmnoprstuy", "আবচদএফগহইজকলমনওপরসতউয"
    return t.texts.withColumn("review_text", F.expr(
        f"CASE review_id % 3 WHEN 1 THEN replace(replace(translate(lower(review_text), '{src}', '{dst}'), 'ওন', 'ো'), 'য', 'য়') "
        f"WHEN 2 THEN array_join(transform(split(review_text, ' '), (w, i) -> CASE i % 2 WHEN 0 THEN translate(lower(w), '{src}', '{dst}') ELSE w END), ' ') "
        "ELSE review_text END"))


BANGLA_TEXTS = """bangla_texts AS MATERIALIZED (SELECT doc_id AS review_id, source, CASE doc_id % 3
  WHEN 1 THEN replace(replace(translate(lower(text), 'abcdefghijklmnoprstuy', 'আবচদএফগহইজকলমনওপরসতউয'), 'ওন', 'ো'), 'য', 'য' || chr(2492))
  WHEN 2 THEN array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE i % 2 WHEN 1 THEN translate(lower(w), 'abcdefghijklmnoprstuy', 'আবচদএফগহইজকলমনওপরসতউয') ELSE w END), ' ')
  ELSE text END AS review_text FROM documents)"""


def normalize_sql(x: str) -> str:
    x = f"translate(nfc_normalize({x}), {q(vocab.INVISIBLE_CHARS)}, '')"
    for a, b in vocab.BENGALI_COMPOSE:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return squeeze_sql(x)


def phonetic_sql(x: str) -> str:
    x = f"lower({x})"
    for k, s in vocab.BENGALI_SOUNDS.items():
        if len(s) > 1:
            x = f"replace({x}, {q(k)}, {q(s)})"
    one = [(k, s) for k, s in vocab.BENGALI_SOUNDS.items() if len(s) == 1]
    gone = "".join(k for k, s in vocab.BENGALI_SOUNDS.items() if s == "")
    x = f"translate({x}, {q(''.join(k for k, _ in one) + gone)}, {q(''.join(s for _, s in one))})"
    x = f"regexp_replace({x}, '[^a-z\\p{{Nd}} ]', '', 'g')"
    for a, b in vocab.LATIN_FOLDS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    # Vowels after the first letter of a word go; then runs of one letter shrink to one.
    x = f"array_to_string(list_transform(string_split({x}, ' '), lambda w: concat(substr(w, 1, 1), regexp_replace(substr(w, 2), '[aeiouy]', '', 'g'))), ' ')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return squeeze_sql(x)


query("lng_1_normalize_bangla", f"WITH {BANGLA_TEXTS} SELECT review_id, {normalize_sql('review_text')} AS body FROM bangla_texts")(
    lambda t: bangla_texts(t).select("review_id", L.normalize_bangla(F.col("review_text")).alias("body")))
query("lng_2_phonetic_key", f"WITH {BANGLA_TEXTS}, n AS MATERIALIZED (SELECT review_id, {normalize_sql('review_text')} AS body FROM bangla_texts) SELECT review_id, {phonetic_sql('body')} AS phonetic_key FROM n")(
    lambda t: bangla_texts(t).select("review_id", L.phonetic_key(F.col("review_text")).alias("phonetic_key")))
query("lng_3_loose_key", f"""WITH {BANGLA_TEXTS}, n AS MATERIALIZED (SELECT review_id, {normalize_sql('review_text')} AS body FROM bangla_texts),
k AS MATERIALIZED (SELECT review_id, replace(replace({phonetic_sql('body')}, 'ng', 'n'), 'ck', 'k') AS key FROM n)
SELECT review_id, array_to_string(list_transform(string_split(key, ' '), lambda w: CASE WHEN length(w) > 3 AND right(w, 1) IN ('s', 'h') THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') AS loose_key FROM k
""")(lambda t: bangla_texts(t).select("review_id", L.loose_key(F.col("review_text")).alias("loose_key")))
SCRIPT = f"""scripts AS MATERIALIZED (SELECT review_id, source, body, len(regexp_extract_all(body, '{BN}')) AS bn, len(regexp_extract_all(body, '[A-Za-z]')) AS la,
  len(list_filter(string_split(body, ' '), lambda w: len(regexp_extract_all(w, '{BN}')) > 0 AND len(regexp_extract_all(w, '{BN}')) >= len(regexp_extract_all(w, '[A-Za-z]')))) AS bw,
  len(list_filter(string_split(body, ' '), lambda w: len(regexp_extract_all(w, '[A-Za-z]')) > len(regexp_extract_all(w, '{BN}')))) AS lw
  FROM (SELECT review_id, source, {normalize_sql('review_text')} AS body FROM bangla_texts))"""
query("lng_4_script_shares", f"""WITH {BANGLA_TEXTS}, {SCRIPT}
SELECT review_id, coalesce(round(bn::DOUBLE / nullif(bn + la, 0), 6), 0) AS bengali_share, coalesce(round(la::DOUBLE / nullif(bn + la, 0), 6), 0) AS latin_share,
  CAST(bw AS INTEGER) AS bengali_words, CAST(lw AS INTEGER) AS latin_words FROM scripts
""")(lambda t: bangla_texts(t).withColumn("body", L.normalize_bangla(F.col("review_text"))).select(
    "review_id", *[F.round(c, 6).alias(n) for c, n in zip(L.script_shares(F.col("body")), ("bengali_share", "latin_share"))],
    *[c.alias(n) for c, n in zip(L.script_words(F.col("body")), ("bengali_words", "latin_words"))]))
MARKERS = "[" + ", ".join(q(m) for m in vocab.BANGLISH_MARKERS) + "]"


def language_rows(t: Tables):
    label = L.language_label(F.col("review_text"))
    return bangla_texts(t).select("review_id", "source", label.alias("l")).select(
        "review_id", "source", F.col("l.label").alias("language_label"), F.col("l.method").alias("language_method"),
        F.round("l.confidence", 3).alias("language_confidence"), F.col("l.iso").alias("detected_iso"), F.lit("original").alias("text_basis"))


LABEL_ROWS = f"""{BANGLA_TEXTS}, {SCRIPT},
marked AS (SELECT *, least(bw, lw) AS mi, bw + lw AS tw, len(regexp_extract_all(lower(body), '[a-z]+')) AS n,
  len(list_filter(regexp_extract_all(lower(body), '[a-z]+'), lambda w: list_contains({MARKERS}, w))) AS hits,
  len(regexp_extract_all(lower(body), '{vocab.ENGLISH_CLAUSE}')) AS clause FROM scripts),
label_rows AS MATERIALIZED (SELECT review_id, source, 'original' AS text_basis,
  CASE WHEN body = '' THEN '' WHEN bn + la = 0 THEN '' WHEN mi >= 2 AND mi / tw >= 0.25 THEN 'mixed' WHEN bn > la THEN 'bn'
    WHEN hits >= 2 OR (hits = 1 AND n <= 6) THEN CASE WHEN clause >= 2 THEN 'mixed' ELSE 'bn-latn' END ELSE 'en' END AS language_label,
  CASE WHEN body = '' THEN 'empty' WHEN bn + la = 0 THEN 'no-letters' WHEN mi >= 2 AND mi / tw >= 0.25 THEN 'script-mix' WHEN bn > la THEN 'script'
    WHEN hits >= 2 OR (hits = 1 AND n <= 6) THEN 'heuristic' WHEN length(body) < 50 THEN 'short-text' ELSE 'script' END AS language_method,
  CASE WHEN body = '' THEN 0.0::DOUBLE WHEN bn + la = 0 THEN NULL WHEN mi >= 2 AND mi / tw >= 0.25 THEN round(round(mi::DOUBLE / tw * 2, 4), 3) WHEN bn > la THEN NULL
    WHEN hits >= 2 OR (hits = 1 AND n <= 6) THEN round(round(least(1.0::DOUBLE, hits::DOUBLE / n * 3), 4), 3) END AS language_confidence,
  CASE WHEN body = '' OR bn + la = 0 OR (mi >= 2 AND mi / tw >= 0.25) THEN '' WHEN bn > la THEN 'bn' WHEN hits >= 2 OR (hits = 1 AND n <= 6) THEN 'bn-latn' ELSE 'en' END AS detected_iso FROM marked)"""
query("lng_5_language_label", f"WITH {LABEL_ROWS} SELECT review_id, source, language_label, language_method, language_confidence, detected_iso, text_basis FROM label_rows")(language_rows)
query("agg_12_language_mix", f"""WITH {LABEL_ROWS}
SELECT language_label, language_method, text_basis, count(*) AS review_count, round(avg(language_confidence), 3) AS avg_confidence, round(avg(n_chars % 5 + 1), 3) AS avg_rating
FROM label_rows JOIN documents ON doc_id = review_id GROUP BY 1, 2, 3
""")(lambda t: rollups.language_mix(language_rows(t), t.raw("documents").selectExpr("doc_id AS review_id", "n_chars % 5 + 1 AS review_rating")))
query("agg_12_language_share", f"""WITH {LABEL_ROWS}
SELECT language_label, count(*) AS review_count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share,
  sum(CASE WHEN language_label IN ('bn', 'bn-latn', 'mixed') THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER () >= 0.2 AS meets_target FROM label_rows GROUP BY 1
""")(lambda t: rollups.language_share(language_rows(t)))
query("agg_12_language_by_tag", f"""WITH {LABEL_ROWS}
SELECT language_label AS detected_language, lang AS platform_language_tag, d.source, count(*) AS review_count FROM label_rows JOIN documents d ON doc_id = review_id GROUP BY 1, 2, 3
""")(lambda t: rollups.language_by_tag(language_rows(t).selectExpr("review_id", "language_label AS detected_language").join(
    t.texts.selectExpr("review_id", "source", "review_language AS platform_language_tag"), "review_id")))
query("lng_8_text_basis", f"""
SELECT doc_id AS review_id, CASE WHEN doc_id % 2 = 0 AND {strip_sql('text')} <> '' THEN text ELSE concat('Clean ', text) END AS text, CASE WHEN doc_id % 2 = 0 AND {strip_sql('text')} <> '' THEN 'original' ELSE 'clean' END AS text_basis FROM documents
""")(lambda t: prep.text_basis(t.raw("documents").selectExpr(
    "doc_id AS review_id", "CASE WHEN doc_id % 2 = 0 THEN text ELSE ' ' END AS review_text_original", "concat('Clean ', text) AS review_text_clean")).select("review_id", "text", "text_basis"))
query("lng_9_name_forms", """
WITH n AS (SELECT p_partkey AS place_id, concat(CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END, p_name, ' beach', CASE WHEN p_size % 3 = 0 THEN concat(' (', p_brand, ')') ELSE '' END) AS name, p_name, p_size, p_brand FROM part)
SELECT place_id, lower(name) AS norm, concat(CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END, p_name, ' beach') AS bare, regexp_replace(name, '^The ', '') AS no_article,
  concat(p_name, CASE WHEN p_size % 3 = 0 THEN lower(concat(' ', replace(p_brand, '#', ' '))) ELSE '' END) AS core,
  list_distinct([name, concat(CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END, p_name, ' beach')] || CASE WHEN p_size % 3 = 0 THEN [p_brand] ELSE [] END
   || [regexp_replace(name, '^The ', ''), concat(p_name, ' beach')]).list_sort() AS forms FROM n
""")(lambda t: t.raw("part").selectExpr("p_partkey AS place_id", "concat(CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE '' END, p_name, ' beach', CASE WHEN p_size % 3 = 0 THEN concat(' (', p_brand, ')') ELSE '' END) AS name").select(
    "place_id", T.norm_name(F.col("name")).alias("norm"), T.strip_qualifier(F.col("name")).alias("bare"), T.strip_article(F.col("name")).alias("no_article"),
    T.core_name(F.col("name")).alias("core"), F.array_sort(T.query_forms(F.col("name"))).alias("forms")))
query("lng_10_spelling_forms", f"""WITH {BANGLA_TEXTS}, w AS (SELECT DISTINCT unnest(string_split(review_text, ' ')) AS term FROM bangla_texts)
SELECT term, list_sort(list_distinct([term, replace(replace(replace(term, 'য' || chr(2492), chr(2527)), 'ড' || chr(2492), chr(2524)), 'ঢ' || chr(2492), chr(2525)),
  replace(replace(replace(term, chr(2527), 'য' || chr(2492)), chr(2524), 'ড' || chr(2492)), chr(2525), 'ঢ' || chr(2492))])) AS forms FROM w WHERE contains(term, chr(2492))
""")(lambda t: bangla_texts(t).select(F.explode(F.split("review_text", " ")).alias("term")).filter(F.contains("term", F.lit("়"))).distinct().select(
    "term", F.array_sort(T.spelling_forms(F.col("term"))).alias("forms")))
query("lng_13_merge_proposals", """
WITH mined AS (SELECT p_name AS bangla, p_brand AS place, count(*) AS reviews FROM part GROUP BY 1, 2),
decided AS (SELECT DISTINCT p_name AS bangla, p_brand AS place, CASE WHEN p_brand < 'Brand#2' THEN 'accept' ELSE 'reject' END AS decision, 'seen' AS reason FROM part WHERE p_size < 5
  UNION ALL SELECT r_name, 'hand', 'accept', '' FROM region)
SELECT bangla, place, coalesce(reviews, 0) AS reviews, coalesce(decision, 'pending') AS decision, coalesce(reason, '') AS reason FROM mined FULL JOIN decided USING (bangla, place)
""")(lambda t: prep.merge_proposals(
    t.raw("part").groupBy(F.col("p_name").alias("bangla"), F.col("p_brand").alias("place")).agg(F.count(F.lit(1)).alias("reviews")),
    t.raw("part").filter("p_size < 5").selectExpr("p_name AS bangla", "p_brand AS place", "CASE WHEN p_brand < 'Brand#2' THEN 'accept' ELSE 'reject' END AS decision", "'seen' AS reason").distinct()
    .unionByName(t.raw("region").selectExpr("r_name AS bangla", "'hand' AS place", "'accept' AS decision", "'' AS reason")), ["bangla", "place"]))
