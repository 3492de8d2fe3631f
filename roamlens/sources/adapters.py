"""Canonical review frames bound to the driver's tables.

Operators take frames with canonical columns; these adapters supply them from the star
schema (suppliers as places, line items as reviews, parts as topics) and the text tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens.operators import joins, topics
from roamlens.session import broadcast_if_small


class Tables:
    """Lazy canonical frames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- star schema as reviews of places -------------------------------------
    @cached_property
    def geography(self) -> DataFrame:
        nation = self.raw("nation").join(
            broadcast_if_small(self.raw("region")), F.expr("n_regionkey = r_regionkey"))
        return nation.selectExpr("n_nationkey", "n_name AS district", "r_name AS division")

    @cached_property
    def places(self) -> DataFrame:
        s = self.raw("supplier").join(
            broadcast_if_small(self.geography), F.expr("s_nationkey = n_nationkey"))
        return s.selectExpr(
            "s_suppkey AS place_id", "s_name AS place_name",
            "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat(district, '/', s_suppkey % 3) END AS city",
            "district", "division",
            "CASE WHEN s_acctbal < 2500 THEN 'hotel' ELSE 'sight' END AS category",
            "CASE WHEN s_acctbal < 2500 THEN 'accommodation' ELSE 'attraction' END AS place_kind",
            "'list' AS source", "round(s_acctbal / 2000, 1) AS place_avg_rating",
            "concat('http://maps/', s_suppkey) AS source_url",
            "CASE WHEN s_acctbal < 0 THEN NULL ELSE 20.5D + CAST(s_suppkey * 37 % 620 AS double) / 100 END AS lat",
            "CASE WHEN s_acctbal < 0 THEN NULL ELSE 88.0D + CAST(s_suppkey * 91 % 470 AS double) / 100 END AS lng",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        part = self.raw("part").selectExpr("p_partkey", "CAST(substr(p_brand, 7) AS int) AS brand")
        line = self.raw("lineitem").join(broadcast_if_small(part), F.expr("l_partkey = p_partkey"), "left")
        return line.selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id",
            "l_suppkey AS place_id",
            "CASE WHEN l_discount = 0.1 THEN NULL WHEN l_discount = 0.09 THEN -1 ELSE brand END AS topic_id",
            "l_returnflag AS source", "CAST(ceil(l_quantity / 10) AS int) AS review_rating",
            "CAST(l_shipdate AS date) AS review_date",
            "date_format(l_shipdate, 'yyyy-MM') AS review_month", "year(l_shipdate) AS review_year",
            "CASE WHEN l_linestatus = 'F' THEN 'bn' ELSE 'en' END AS detected_language",
            "CAST(round(l_extendedprice / 100) AS int) AS text_length",
        )

    # ---- parts as topics and preferences --------------------------------------
    @cached_property
    def topics_summary(self) -> DataFrame:
        part = self.raw("part").selectExpr("CAST(substr(p_brand, 7) AS int) AS topic_id", "p_name")
        g = part.groupBy("topic_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
        return g.selectExpr(
            "topic_id", "concat(topic_id, '_', replace(lo, ' ', '_')) AS topic_name",
            "CASE WHEN topic_id % 5 = 0 THEN '' ELSE concat(lo, ', ', hi) END AS top_keywords",
            "n AS review_count",
        )

    @cached_property
    def interpretations(self) -> DataFrame:
        return self.topics_summary.filter("topic_id <> 7").selectExpr(
            "topic_id", "concat('Theme ', topic_id) AS interpreted_label",
            "concat('reviews about ', replace(topic_name, '_', ' ')) AS interpretation",
            "CASE WHEN topic_id < 10 THEN 'nature' ELSE 'culture' END AS dimension_hint",
        )

    @cached_property
    def preference_classes(self) -> DataFrame:
        return self.raw("part").select("p_type").distinct().selectExpr(
            "concat('P-', p_type) AS preference_id",
            "CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'Size' ELSE 'Range' END AS category",
            "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Ends' WHEN p_type IN ('MEDIUM', 'STANDARD') "
            "THEN 'Middle' ELSE 'Offers' END AS subcategory",
            "lower(p_type) AS preference_label",
            "concat('visitors who like ', lower(p_type), ' things') AS preference_description",
            "CAST(NULL AS string) AS preference_type",
        )

    @cached_property
    def topic_scores(self) -> DataFrame:
        """Similarity of each topic to each preference, from how often they meet."""
        part = self.raw("part").selectExpr(
            "CAST(substr(p_brand, 7) AS int) AS topic_id", "concat('P-', p_type) AS preference_id")
        cell = part.groupBy("topic_id", "preference_id").agg(F.count(F.lit(1)).alias("n"))
        total = part.groupBy("topic_id").agg(F.count(F.lit(1)).alias("total"))
        return cell.join(total, "topic_id").selectExpr(
            "topic_id", "preference_id", "least(1.0D, n * 2.2D / total) AS similarity")

    @cached_property
    def topic_mapping(self) -> DataFrame:
        return topics.best_two(self.topic_scores, self.preference_classes, self.interpretations)

    @cached_property
    def precision(self) -> DataFrame:
        return topics.precision_checks(self.topic_mapping)

    @cached_property
    def secondary(self) -> DataFrame:
        return topics.secondary_mapping(self.precision)

    @cached_property
    def coverage(self) -> DataFrame:
        return topics.coverage_checks(self.topic_mapping, self.preference_classes, self.secondary)

    @cached_property
    def topic_map(self) -> DataFrame:
        return topics.topic_preference_map(self.topic_mapping, self.secondary)

    @cached_property
    def long_tail(self) -> DataFrame:
        counts = self.reviews.groupBy("topic_id").agg(F.count(F.lit(1)).alias("review_count"))
        total = self.reviews.agg(F.count(F.lit(1)).alias("n")).scalar()
        return (
            self.topic_mapping.select("topic_id", "interpreted_label", "preference_id", "similarity")
            .join(counts, "topic_id")
            .withColumn("corpus_share", F.bround(F.col("review_count") / total, 4))
            .selectExpr(
                "topic_id", "interpreted_label", "preference_id", "review_count", "corpus_share",
                "corpus_share < 0.04D AS scarce", "round(similarity, 4) AS max_sim_to_abundant",
                "round(1 - similarity, 4) AS sdd",
                "CASE WHEN corpus_share < 0.03D AND 1 - similarity > 0.5D THEN 'long_tail' ELSE 'mainstream' END AS preference_type",
                "corpus_share < 0.03D AND 1 - similarity > 0.5D AS is_long_tail",
            )
        )

    @cached_property
    def topics(self) -> DataFrame:
        return topics.topic_dimension(self.topics_summary, self.interpretations, self.reviews)

    @cached_property
    def preferences(self) -> DataFrame:
        return topics.preference_dimension(self.preference_classes, self.long_tail)

    @cached_property
    def spine(self) -> DataFrame:
        return joins.review_spine(self.reviews, self.places, self.topics, self.topic_map, self.preferences)

    @cached_property
    def spine_all(self) -> DataFrame:
        return joins.review_spine(self.reviews, self.places, self.topics, self.topic_map,
                                  self.preferences, all_ranks=True)

    # ---- orders as host reviews, their lines as mentions ------------------------
    @cached_property
    def host_reviews(self) -> DataFrame:
        c = self.raw("customer").join(
            broadcast_if_small(self.geography), F.expr("c_nationkey = n_nationkey"))
        c = c.selectExpr("c_custkey", "c_nationkey", "concat(district, ' ', c_mktsegment) AS place_name",
                         "district", "division")
        return self.raw("orders").join(c, F.expr("o_custkey = c_custkey"), "left").selectExpr(
            "CAST(o_orderkey AS string) AS review_id", "place_name", "district", "division",
            "least(5, CAST(ceil(o_totalprice / 100000) AS int)) AS review_rating",
            "CAST(o_orderdate AS date) AS review_date", "o_orderpriority AS source",
            "CASE o_orderstatus WHEN 'F' THEN 'bn' WHEN 'O' THEN 'en' ELSE 'bn-en-mixed' END AS detected_language",
            "CASE WHEN c_nationkey < 4 THEN ' Bangladesh' WHEN c_nationkey < 12 THEN district "
            "WHEN c_nationkey < 14 THEN 'nan' ELSE NULL END AS user_location",
        )

    @cached_property
    def host_geography(self) -> DataFrame:
        c = self.raw("customer").join(
            broadcast_if_small(self.geography), F.expr("c_nationkey = n_nationkey"))
        return c.selectExpr("concat(district, ' ', c_mktsegment) AS place_name", "district", "division",
                            "CAST(21.0D + n_nationkey / 10.0D AS double) AS lat",
                            "CAST(89.0D + n_nationkey / 10.0D AS double) AS lng").distinct()

    @cached_property
    def mentions(self) -> DataFrame:
        part = self.raw("part").selectExpr("p_partkey", "p_name", "p_brand", "p_type")
        m = self.raw("lineitem").join(broadcast_if_small(part), F.expr("l_partkey = p_partkey"))
        m = m.selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS mention_id",
            "CAST(l_orderkey AS string) AS review_id",
            "CASE p_type WHEN 'STANDARD' THEN 'FOOD' WHEN 'SMALL' THEN 'ACTIVITY' WHEN 'ECONOMY' THEN 'ACCESS' "
            "WHEN 'PROMO' THEN 'TIP' ELSE 'PLACE' END AS entity_type",
            "CASE WHEN l_returnflag = 'R' THEN upper(concat(p_name, ' ', p_brand)) "
            "ELSE concat(p_name, ' ', p_brand) END AS surface",
            "CAST(l_quantity AS int) AS quantity", "l_linestatus",
        )
        return m.selectExpr(
            "mention_id", "review_id", "entity_type", "surface",
            "trim(repeat(concat(surface, '. '), quantity % 9 + 1)) AS sentence",
            "CASE WHEN l_linestatus = 'F' THEN 'bn' ELSE 'en' END AS language",
            "CASE WHEN quantity % 3 = 0 THEN 'case' ELSE 'exact' END AS match_kind",
            "'gazetteer' AS extractor",
        )

    @cached_property
    def variants(self) -> DataFrame:
        g = self.mentions.groupBy("entity_type", "surface").agg(F.count(F.lit(1)).alias("mentions"))
        return g.selectExpr("concat(entity_type, '/', lower(surface)) AS entity_id", "surface", "entity_type",
                            "mentions")

    @cached_property
    def entities(self) -> DataFrame:
        m = self.mentions.selectExpr("concat(entity_type, '/', lower(surface)) AS entity_id", "entity_type",
                                     "surface", "review_id")
        return m.groupBy("entity_id", "entity_type").agg(
            F.lower(F.min("surface")).alias("canonical_name"),
            F.count_distinct("surface").alias("n_variants"),
            F.count(F.lit(1)).alias("n_mentions"),
            F.count_distinct("review_id").alias("n_reviews"),
        )

    @cached_property
    def linked_mentions(self) -> DataFrame:
        """Mentions with their entity; a surface of another type is another entity."""
        return self.mentions.withColumn(
            "entity_id", F.expr("concat(entity_type, '/', lower(surface))"))

    @cached_property
    def lookups(self) -> DataFrame:
        """What two public sources said about each place entity."""
        p = self.raw("part").selectExpr(
            "concat('PLACE/', lower(concat(p_name, ' ', p_brand))) AS entity_id",
            "lower(concat(p_name, ' ', p_brand)) AS name", "p_type", "p_size", "p_retailprice", "p_partkey")
        p = p.filter("p_type IN ('MEDIUM', 'LARGE')")
        g = p.groupBy("entity_id", "name").agg(
            F.max("p_size").alias("top"), F.min("p_partkey").alias("k"), F.sum("p_size").alias("all_size"))
        return g.selectExpr(
            "entity_id", "name", "CASE WHEN k % 11 = 0 THEN 'error' ELSE 'ok' END AS osm_status",
            "CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS wikidata_status",
            "k % 3 <> 0 AS osm_found", "k % 2 = 0 AS wikidata_found",
            "CASE WHEN k % 3 <> 0 THEN round(top / 200.0D, 3) END AS osm_importance",
            "CASE WHEN k % 2 = 0 THEN CAST(all_size % 25 AS int) END AS wikidata_sitelinks",
            "CASE WHEN k % 5 = 0 THEN name END AS maps_place",
            "CASE WHEN k % 5 = 0 AND k % 10 = 0 THEN CAST(k * 13 % 2000 AS bigint) END AS maps_review_count",
            "CASE WHEN k % 4 = 0 THEN 22.0D + CAST(k % 40 AS double) / 10 END AS lat",
            "CASE WHEN k % 4 = 0 THEN 89.0D + CAST(k % 30 AS double) / 10 END AS lng",
        )

    # ---- documents as review texts ----------------------------------------------
    @cached_property
    def texts(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS review_id", "source", "source AS place_name", "text AS review_text",
            "lang AS review_language")
