"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "agg_1_place_stats", "agg_4_rating_distribution", "agg_9_venue_preferences", "agg_13_entity_evidence", "agg_14_place_attributes",
    "agg_16_place_links", "agg_21_audience_comparison", "pre_1_clean_text", "pre_5_first_by_text", "lng_2_phonetic_key",
    "lng_5_language_label", "topic_3_keywords", "topic_2_reassign_outliers", "gem_6_recency", "join_1_review_spine",
    "ret_5_recommend", "stat_1_rank_tests", "topic_16_sample_ladder", "topic_1_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from roamlens.session import get_session

    spark = get_session("roamlens-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from roamlens.plans import load

    queries = load()[0]
    queries["agg_4_rating_distribution"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
