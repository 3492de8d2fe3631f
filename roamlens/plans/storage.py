"""Batches, sinks and the warehouse: tables written to the shared folder and read back; search over every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.operators import retrieval, rollups
from roamlens.plans.people import _scratch
from roamlens.plans.registry import query
from roamlens.plans.serving import frequency, stats
from roamlens.sources import batches, sinks
from roamlens.sources.adapters import Tables


def exported(t: Tables):
    """The documents as two CSV batches with different optional columns, read back as one table."""
    base = _scratch(t)
    rows = t.raw("documents").selectExpr("CAST(doc_id AS string) AS review_id", "source AS place_name", "text AS review_text", "'list' AS source", "lang AS review_language", "n_chars % 5 AS review_rating")
    write = {"header": True, "escape": '"', "quoteAll": True}
    rows.filter("review_id % 2 = 0").drop("review_rating").write.options(**write).csv(f"{base}/first")
    rows.filter("review_id % 2 = 1").drop("review_language").select("source", "review_text", "review_rating", "place_name", "review_id").write.options(**write).csv(f"{base}/second")
    return batches.scan_batches(t.spark, f"{base}/*/*.csv").select("review_id", "place_name", "review_text", "review_language", "review_rating")


query("src_1_scan_batches", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS place_name, text AS review_text, CASE WHEN doc_id % 2 = 0 THEN lang END AS review_language, CASE WHEN doc_id % 2 = 1 THEN CAST(n_chars % 5 AS VARCHAR) END AS review_rating FROM documents
""")(exported)


def optional(t: Tables):
    """A table that is there and one that is not, under one schema."""
    schema = t.raw("nation").schema
    there = batches.scan_optional(t.spark, f"{t.folder}/nation.parquet", schema)
    return there.unionByName(batches.scan_optional(t.spark, f"{_scratch(t)}/missing", schema)).select("n_nationkey", "n_name")


query("src_2_scan_optional", "SELECT n_nationkey, n_name FROM nation")(optional)


def sunk(t: Tables):
    """Orders per status and priority through each sink."""
    base = _scratch(t)
    rows = t.raw("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    sinks.write_table(rows, f"{base}/parquet", ["o_orderstatus"])
    sinks.write_csv(rows, f"{base}/csv", single_file=True)
    sinks.write_json(rows, f"{base}/json")
    cols = ["o_orderstatus", "o_orderpriority", "CAST(n AS bigint) AS n"]
    read = {"parquet": t.spark.read.parquet(f"{base}/parquet"), "csv": t.spark.read.option("header", True).csv(f"{base}/csv"), "json": t.spark.read.json(f"{base}/json")}
    out = [df.selectExpr(f"'{kind}' AS sink", *cols) for kind, df in read.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


query("snk_1_tables", """
SELECT sink, o_orderstatus, o_orderpriority, count(*) AS n FROM orders, (SELECT unnest(['parquet', 'csv', 'json']) AS sink) GROUP BY 1, 2, 3
""")(sunk)
query("snk_2_warehouse", """
SELECT 'reviews' AS table_name, count(*) AS n_rows FROM reviews UNION ALL SELECT 'places', count(*) FROM places UNION ALL SELECT 'topics', count(*) FROM topics UNION ALL SELECT 'place_stats', count(*) FROM place_stats
""")(lambda t: sinks.build_warehouse({"reviews": t.reviews, "places": t.places, "topics": t.topics, "place_stats": stats(t)}, _scratch(t)))


# ---- search over all kinds ---------------------------------------------------------------------------
def everything(t: Tables):
    part = t.raw("part").withColumn("canonical_name", F.expr("concat(p_name, ' ', p_partkey)")).withColumn("entity_id", F.expr("concat('E', p_partkey)"))
    spelt = t.places.selectExpr("'none' AS entity_id", "'PLACE' AS entity_type", "concat('v', place_id % 20) AS surface", "place_name AS canonical_name").unionByName(
        part.selectExpr("entity_id", "'FOOD' AS entity_type", "concat('g', p_size) AS surface", "canonical_name"))
    return retrieval.search("11", {
        "places": stats(t), "cities": rollups.city_stats(t.places, t.reviews), "variants": spelt,
        "things": part.selectExpr("entity_id", "canonical_name", "CASE p_partkey % 3 WHEN 0 THEN 'FOOD' WHEN 1 THEN 'ACTIVITY' ELSE 'ACCESS' END AS entity_type", "p_size % 4 AS n_places", "p_size AS n_reviews", "concat('s', p_size) AS spellings"),
        "gems": part.filter("p_partkey % 5 = 0").selectExpr("entity_id", "canonical_name", "p_retailprice AS gem_score"),
        "preferences": frequency(t).join(t.preferences.select("preference_id", "preference_description"), "preference_id"), "topics": t.topics,
        "reviews": t.raw("documents").selectExpr("doc_id AS review_id", "text AS review_text", "n_chars % 5 + 1 AS review_rating")})


def _thing(kind: str, k: int) -> str:
    return f"""UNION ALL SELECT * FROM (SELECT '{kind}', concat('E', p_partkey), concat(p_name, ' ', p_partkey), p_size::DOUBLE FROM part WHERE p_partkey % 3 = {k} AND p_size % 4 > 0
  AND (concat(p_name, ' ', p_partkey) ILIKE '%11%' OR concat('s', p_size) ILIKE '%11%') ORDER BY p_size DESC, concat('E', p_partkey) LIMIT 5)"""


query("ret_4_search_all_kinds", f"""
SELECT * FROM (SELECT 'place' AS kind, CAST(place_id AS VARCHAR) AS id, review_count::DOUBLE AS score FROM place_stats
  WHERE place_name ILIKE '%11%' OR city ILIKE '%11%' OR place_id % 20 = 11 ORDER BY review_count DESC, place_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'city', city, review_count::DOUBLE FROM city_stats WHERE city ILIKE '%11%' OR district ILIKE '%11%' ORDER BY review_count DESC, city LIMIT 5)
UNION ALL SELECT kind, id, score FROM (SELECT NULL AS kind, NULL AS id, NULL AS label, NULL::DOUBLE AS score WHERE false {_thing('food', 0)} {_thing('activity', 1)} {_thing('transport', 2)})
UNION ALL SELECT * FROM (SELECT 'gem', concat('E', p_partkey), p_retailprice::DOUBLE FROM part WHERE p_partkey % 5 = 0 AND (concat(p_name, ' ', p_partkey) ILIKE '%11%' OR p_size = 11)
  ORDER BY p_retailprice DESC, concat('E', p_partkey) LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'preference', preference_id, review_count::DOUBLE FROM frequency JOIN (SELECT preference_id, preference_description FROM preferences) USING (preference_id)
  WHERE preference_label ILIKE '%11%' OR preference_description ILIKE '%11%' OR subcategory ILIKE '%11%' ORDER BY review_count DESC, preference_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'topic', CAST(topic_id AS VARCHAR), review_count::DOUBLE FROM topics
  WHERE interpreted_label ILIKE '%11%' OR top_keywords ILIKE '%11%' OR interpretation ILIKE '%11%' ORDER BY review_count DESC, topic_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'review', CAST(doc_id AS VARCHAR), (n_chars % 5 + 1)::DOUBLE FROM documents WHERE text ILIKE '%11%' ORDER BY n_chars % 5 DESC, length(text), doc_id LIMIT 5)
""")(lambda t: everything(t).select("kind", "id", "score"))
