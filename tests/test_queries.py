"""Registered queries against their check SQL."""

from __future__ import annotations

import pytest

from roamlens.plans import load
from tests.checker import compare, connect

QUICK = ["agg_1_place_stats", "agg_9_venue_preferences", "agg_16_place_links", "agg_18_district_coverage", "pre_5_first_by_text", "pre_15_validate_submissions",
         "lng_2_phonetic_key", "lng_5_language_label", "men_2_place_mentions", "gem_9_score", "ret_5_recommend", "stat_1_rank_tests", "topic_8_long_tail",
         "stream_1_daily_volume_streamed", "stream_6_ingest"]


def test_every_check_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, name):
    queries, oracles = load()
    assert compare(queries[name](spark, sf_dir), connect(sf_dir), oracles[name]) == []


@pytest.mark.parametrize("parts", ["1", "16"])
def test_samples_do_not_depend_on_partitions(spark, sf_dir, parts):
    run = load()[0]["topic_15_annotation_pool"]
    base = sorted(r.review_id for r in run(spark, sf_dir).select("review_id").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(r.review_id for r in run(spark, sf_dir).select("review_id").collect()) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
