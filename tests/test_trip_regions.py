"""Places are matched and ranked once for trips that look for the same."""

from pyspark.sql import functions as F

from roamlens.operators import planning, retrieval

WISH = "request_id string, days int, pace string, wanted array<string>, city string, division string, exclude_cities array<string>, min_reviews int, max_regions int"
STATS = "place_id long, place_name string, city string, district string, division string, category string, place_kind string, review_count long, avg_review_rating double"


def test_regions_of_equal_looks_are_those_of_each_trip(spark, monkeypatch):
    looks = [(["P1"], None, None, [], 1), (["P2", "p1"], "c1", None, [], 1), ([], "C0", None, None, 2), ([], None, "d1", ["c1"], 1), (["P1"], "none", None, [], 1), ([], "c2", None, [], None)]
    rows = [(f"{i}-{d}-{pace}", d, pace, *look, cap) for i, look in enumerate(looks) for d in (1, 3, 6) for pace, cap in (("relaxed", None), ("packed", 1), (None, 2))]
    rows += [(None, 2, "standard", *looks[0], None), ("twice", 2, "standard", *looks[1], None), ("twice", 2, "standard", *looks[1], None)]
    requests = spark.createDataFrame(rows, WISH)
    stats = spark.createDataFrame([(i, f"n{i}", f"c{i % 4}" if i % 9 else None, f"s{i % 3}" if i % 5 else None, f"d{i % 2}" if i % 7 else None, "sight", "attraction" if i % 8 else "accommodation", i % 6 + 1, i % 5 + 0.5)
                                   for i in range(60)], STATS)
    venue = spark.createDataFrame([(i, f"P{i % 3}", i // 2 + 1) for i in range(0, 60, 2)] + [(i, "P1", 1) for i in range(1, 60, 4)], "place_id long, preference_id string, review_count long")
    want = planning.regions(planning.candidates(requests, stats, venue))
    asked, ask = [], retrieval.matches
    monkeypatch.setattr(retrieval, "matches", lambda r, *a: (asked.append(r.count()), ask(r, *a))[1])
    got = planning.trip_regions(requests, stats, venue)
    assert asked[0] == len(looks)
    assert got.columns == want.columns and got.count() > 100 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_few_places_meet_the_wishes_in_many_tasks(spark):
    requests = spark.range(30).selectExpr("concat('r', id) AS request_id", "array('P1') AS wanted", "CAST(NULL AS string) AS city", "CAST(NULL AS string) AS division",
                                          "'attraction' AS place_kind", "array('c' || id) AS exclude_cities", "1 AS min_reviews", "3 AS limit")
    stats = spark.range(0, 200, 1, 1).selectExpr("id AS place_id", "'n' AS place_name", "'c' || id AS city", "'s' AS district", "'d' AS division", "'sight' AS category",
                                                       "'attraction' AS place_kind", "5L AS review_count", "4D AS avg_review_rating")
    venue = stats.selectExpr("place_id", "'P1' AS preference_id", "place_id AS review_count")
    got = retrieval.matches(requests, stats, venue)
    assert got.count() == 30 * 199
    assert got.select(F.spark_partition_id().alias("task")).distinct().count() > 2
