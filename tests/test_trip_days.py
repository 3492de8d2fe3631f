"""Days of trips are filled in as many tasks as a shuffle has."""

import pandas as pd
from pyspark import TaskContext

from roamlens.functions.tasks import fill_days
from roamlens.operators import planning


def test_days_of_many_trips_are_not_filled_in_one_task(spark, monkeypatch):
    def where(group: pd.DataFrame) -> pd.DataFrame:
        return fill_days(group).assign(stop=TaskContext.get().partitionId())

    monkeypatch.setattr(planning, "fill_days", where)
    trips = spark.range(60).selectExpr("concat('t', id) AS request_id", "'east' AS region")
    ranked = trips.selectExpr("*", "1 AS pos", "7L AS place_id", "'p' AS place_name", "'c' AS city", "'d' AS district", "'v' AS division", "1D AS match_score",
                              "3L AS review_count", "4D AS avg_rating", "array('x') AS matched_preferences")
    got = planning.day_stops(ranked, trips.selectExpr("*", "1 AS region_rank", "2 AS per_day", "1L AS region_days")).collect()
    assert len(got) == 60 and len({r.stop for r in got}) > 1
