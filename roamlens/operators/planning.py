"""Trip plans for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import vocab
from roamlens.functions.similarity import half_even
from roamlens.functions.tasks import fill_days
from roamlens.operators import retrieval
from roamlens.session import broadcast_if_small, cut_lineage, top_per_key

ONE = "*"  # counted rows
LOOK = ["wanted", "city", "division", "exclude_cities", "min_reviews"]  # what decides which places a trip may use


def alike(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that differ only in their id as one row with an id of its own, and which request has which (plan_id).

    There are as many of them as different wishes, however many ask. Rows that share a request_id stay as they are.
    """
    fields = [c for c in requests.columns if c != "request_id"]
    key = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    keyed = cut_lineage(requests.withColumn("n", F.count(ONE).over(Window.partitionBy("request_id"))).withColumn(
        "plan_id", F.when(F.col("request_id").isNotNull(), F.when(F.col("n") == 1, key).otherwise(F.concat(F.lit("="), F.col("request_id"))))))
    rows = lambda df: df.select(F.col("plan_id").alias("request_id"), *fields)
    one = F.col("request_id").isNotNull() & (F.col("n") == 1)
    return rows(keyed.filter(one)).dropDuplicates(["request_id"]).unionByName(rows(keyed.filter(~one))), keyed.select("request_id", "plan_id").distinct()


def for_each(planned: DataFrame, members: DataFrame) -> DataFrame:
    """What was planned for equal requests, for every request."""
    return planned.withColumnRenamed("request_id", "_plan").join(members, F.col("_plan").eqNullSafe(F.col("plan_id"))).select(*planned.columns)


def _ask(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", "wanted", "city", "division", F.lit("attraction").alias("place_kind"), "exclude_cities",
        "min_reviews", F.lit(None).cast("int").alias("limit"))


def _per_day() -> Column:
    return F.create_map(*[F.lit(x) for kv in vocab.PACE_ACTIVITIES.items() for x in kv])[F.col("pace")]


def _widened(trips: DataFrame, wishes: DataFrame, key: str, stats: DataFrame, venue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matches of each wish, those in its city's division, and the trips that take these: too few are in the city, and more there."""
    find = lambda w: cut_lineage(retrieval.matches(_ask(w.withColumn("request_id", F.col(key))), stats, venue).withColumnRenamed("request_id", key))
    first = find(wishes)
    count = first.groupBy(key).agg(F.count(ONE).alias("found"))
    home = stats.filter("division IS NOT NULL AND city IS NOT NULL").groupBy(F.lower("city").alias("ck")).agg(
        F.min("division").alias("home"))
    thin = (
        trips.filter("city IS NOT NULL AND division IS NULL").join(count, key, "left")
        .fillna(0, ["found"]).filter("found < days * per_day")
        .withColumn("ck", F.lower("city")).join(broadcast_if_small(home), "ck")
    )
    ask = thin if key == "request_id" else thin.dropDuplicates([key])
    wide = find(ask.withColumn("city", F.lit(None).cast("string")).withColumn("division", F.col("home")))
    more = wide.groupBy(key).agg(F.count(ONE).alias("wide_found")).join(
        thin.select("request_id", *([] if key == "request_id" else [key]), "found"), key).filter("wide_found > found")
    return first, wide, more.drop("wide_found", "found")


def candidates(requests: DataFrame, stats: DataFrame, venue: DataFrame) -> DataFrame:
    """All matching attractions per trip; a thin city widens to its division when that gives more.

    ``requests``: request_id, days, pace, wanted, city, division, exclude_cities, min_reviews,
    max_regions.
    """
    trips = requests.withColumn("per_day", _per_day())
    first, wide, more = _widened(trips, trips, "request_id", cut_lineage(stats), cut_lineage(venue))
    kept = first.join(more, "request_id", "left_anti").withColumn("widened", F.lit(False)).unionByName(
        wide.join(more, "request_id", "left_semi").withColumn("widened", F.lit(True)))
    return cut_lineage(kept.join(trips.select("request_id", "days", "per_day", "max_regions", F.col("city").alias("anchor_city")), "request_id"))


def regions(cands: DataFrame) -> DataFrame:
    """Candidates with their region and the region's rank.

    The anchor city's region leads; the others follow by the score of the places a full trip could use there. All
    candidates are counted; of each region only the days * per_day best go on, as no trip can use more.
    """
    c, counts = _in_regions(cands, "request_id", cands)
    return _ranked(c, counts)


def _in_regions(cands: DataFrame, key: str, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best candidates of each region of a ``key``, as many as the longest of all trips can use, and how many there are."""
    region = F.coalesce("division", "district", "city", F.lit("Unknown region"))
    c = cands.withColumn("region", region).withColumn(
        "at_anchor", F.coalesce(F.lower("city") == F.lower("anchor_city"), F.lit(False)))
    best = F.struct((-F.col("match_score")).alias("s"), (-F.col("review_count")).alias("n"), F.col("place_id"))
    anchor = c.filter("at_anchor").groupBy(key).agg(F.min_by("region", best).alias("anchor_region"))
    c = c.join(anchor, key, "left").withColumn("leads", F.coalesce(F.col("region") == F.col("anchor_region"), F.lit(False)))
    counts = c.groupBy(key, "region").agg(F.count(ONE).alias("n_candidates"))
    most = trips.agg(F.coalesce(F.max(F.col("days") * F.col("per_day")), F.lit(0)).alias("m")).first()["m"]  # one number
    return top_per_key(c, [key, "region"], [
        F.desc(F.col("leads") & F.col("at_anchor")), F.desc("match_score"), F.desc("review_count"), F.asc("place_id")], int(most), "pos"), counts


def _ranked(c: DataFrame, counts: DataFrame) -> DataFrame:
    c = c.filter(F.col("pos") <= F.col("days") * F.col("per_day"))
    trip = Window.partitionBy("request_id")
    r = c.groupBy("request_id", "region", "leads", "days", "per_day", "max_regions").agg(
        F.round(F.sum("match_score"), 6).alias("region_score")).join(counts, ["request_id", "region"])
    order = Window.partitionBy("request_id").orderBy(F.desc("leads"), F.desc("region_score"), F.asc("region"))
    r = r.withColumn("region_rank", F.row_number().over(order)).withColumn("n_regions", F.count(ONE).over(trip))
    return cut_lineage(c.select("request_id", "region", "pos", "place_id", "place_name", "city", "district", "division",
                                "match_score", "review_count", "avg_rating", "matched_preferences").join(r, ["request_id", "region"]))


def trip_regions(requests: DataFrame, stats: DataFrame, venue: DataFrame) -> DataFrame:
    """``regions`` of the ``candidates`` of each request; places are matched and ranked once for requests that look for the same.

    Requests that differ in days, pace or regions use more or less of one list. Rows that share a request_id are planned by themselves.
    """
    asked = requests.filter("request_id IS NOT NULL").withColumn("n", F.count(ONE).over(Window.partitionBy("request_id"))).withColumn(
        "per_day", _per_day()).withColumn("look", F.sha2(F.to_json(F.struct(*LOOK), {"ignoreNullFields": "false"}), 256))
    asked = cut_lineage(asked)
    shared = asked.filter("n > 1").select(*requests.columns)
    asked = asked.filter("n = 1")
    stats, venue = cut_lineage(stats), cut_lineage(venue)
    first, wide, more = _widened(asked, asked.select("look", *LOOK).dropDuplicates(["look"]), "look", stats, venue)
    anchor = asked.select("look", F.col("city").alias("anchor_city")).distinct()
    cands = first.withColumn("widened", F.lit(False)).unionByName(wide.join(more.select("look").distinct(), "look", "left_semi").withColumn(
        "widened", F.lit(True))).join(anchor, "look").withColumn("look", F.concat("look", F.col("widened").cast("string")))
    widened = more.select("request_id", F.lit(True).alias("w"))
    members = asked.select("request_id", "look", "days", "per_day", "max_regions").join(widened, "request_id", "left").withColumn(
        "look", F.concat("look", F.col("w").isNotNull().cast("string"))).drop("w")
    c, counts = _in_regions(cands, "look", asked)
    planned = _ranked(cut_lineage(c).join(members, "look"), counts.join(members.select("look", "request_id"), "look").drop("look"))
    return planned if shared.isEmpty() else planned.unionByName(regions(candidates(shared, stats, venue)))


def allocate_days(ranked: DataFrame) -> DataFrame:
    """Days per region, best first: each gets what it can fill until the trip is full."""
    cap = F.coalesce("max_regions", F.greatest(F.lit(1), F.least(F.col("n_regions"), F.floor(F.col("days") / 2) + 1)))
    r = ranked.select("request_id", "region", "region_rank", "region_score", "n_candidates", "days", "per_day", cap.alias("cap")).distinct()
    want = F.when(F.col("region_rank") <= F.col("cap"), F.ceil(F.col("n_candidates") / F.col("per_day"))).otherwise(0)
    before = Window.partitionBy("request_id").orderBy("region_rank").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("want", want.cast("long")).withColumn("used", F.coalesce(F.sum("want").over(before), F.lit(0)))
    got = F.greatest(F.lit(0), F.least(F.col("want"), F.col("days") - F.col("used")))
    r = r.withColumn("region_days", got.cast("long"))
    whole = Window.partitionBy("request_id")
    return r.withColumn("spare_days", F.col("days") - F.sum("region_days").over(whole)).select(
        "request_id", "region", "region_rank", "region_score", "n_candidates", "days", "per_day", "region_days", "spare_days")


_DAY = "request_id string, region string, region_rank int, region_day int, stop int, place_id long"


def day_stops(ranked: DataFrame, allocation: DataFrame) -> DataFrame:
    """Stops per day. A group is one region of one trip: at most days * per_day places."""
    a = allocation.filter("region_days > 0").select("request_id", "region", "region_rank", "per_day", "region_days")
    base = ranked.select("request_id", "region", "pos", "place_id", "district", "city").join(a, ["request_id", "region"])
    spread = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few but slow, so they are not gathered into fewer tasks
    filled = cut_lineage(base.repartition(spread, "request_id", "region").groupBy("request_id", "region").applyInPandas(fill_days, _DAY))
    days = filled.select("request_id", "region", "region_rank", "region_day").distinct().withColumn(
        "day", F.row_number().over(Window.partitionBy("request_id").orderBy("region_rank", "region_day")))
    return cut_lineage(filled.join(days, ["request_id", "region", "region_rank", "region_day"]).join(
        ranked.select("request_id", "region", "place_id", "place_name", "city", "district", "division", "match_score",
                      "review_count", "avg_rating", "matched_preferences"), ["request_id", "region", "place_id"]).drop("region_day"))


def day_moves(stops: DataFrame) -> DataFrame:
    """Base of each day, the kind of move from the day before, and whether it spans districts."""
    base = stops.groupBy("request_id", "day").agg(
        F.min_by(F.struct("city", "district", "division"), F.col("stop")).alias("b"),
        F.count(ONE).alias("n_stops"), F.count_distinct("district").alias("n_districts"))
    trip = Window.partitionBy("request_id").orderBy("day")
    b = base.select("request_id", "day", "b.*", "n_stops", (F.col("n_districts") > 1).alias("spans_districts"))
    prev = {c: F.lag(c).over(trip) for c in ("city", "district", "division")}
    level = (
        F.when(F.lag("day").over(trip).isNull(), "start")
        .when(prev["city"] == F.col("city"), "same_city").when(prev["district"] == F.col("district"), "same_district")
        .when(prev["division"] == F.col("division"), "same_division").otherwise("cross_division"))
    return b.withColumn("travel_level", level)


def stays(moves: DataFrame, stats: DataFrame) -> DataFrame:
    """Best rated lodging of each day's city, else of its division."""
    h = stats.filter("place_kind = 'accommodation' AND review_count >= 1").withColumn(
        "s", half_even(0.75 * F.coalesce("avg_review_rating", F.lit(0.0)) / 5 + 0.25 * F.least(F.col("review_count") / 50.0, F.lit(1.0)), 4))
    best = F.struct((-F.col("s")).alias("s"), (-F.col("review_count")).alias("n"), F.col("place_id"))
    pick = lambda c: h.filter(F.col(c).isNotNull()).groupBy(F.lower(c).alias(f"k_{c}")).agg(
        F.min_by("place_id", best).alias(f"{c}_stay"))
    return (
        moves.withColumn("k_city", F.lower("city")).withColumn("k_division", F.lower("division"))
        .join(broadcast_if_small(pick("city")), "k_city", "left").join(broadcast_if_small(pick("division")), "k_division", "left")
        .select("request_id", "day", F.coalesce("city_stay", "division_stay").alias("stay_place_id"),
                F.when(F.col("city_stay").isNotNull(), "city").when(F.col("division_stay").isNotNull(), "division").alias("stay_scope"))
    )


def trip_summary(requests: DataFrame, stops: DataFrame, moves: DataFrame, venue: DataFrame) -> DataFrame:
    """Totals per trip: places, ratings, evidence and which wanted preferences are backed."""
    wish = requests.select("request_id", F.transform(F.coalesce("wanted", F.array().cast("array<string>")), F.upper).alias("wanted"), "days")
    ev = stops.select("request_id", "place_id").join(
        broadcast_if_small(wish), "request_id").join(
        venue.select("place_id", F.upper("preference_id").alias("pref"), F.col("review_count").alias("n")), "place_id")
    ev = ev.filter((F.size("wanted") == 0) | F.array_contains("wanted", F.col("pref")))
    proof = ev.groupBy("request_id").agg(F.sum("n").alias("evidence_reviews"), F.collect_set("pref").alias("covered"))
    s = stops.groupBy("request_id").agg(
        F.count(ONE).alias("total_activities"), F.count_distinct("place_id").alias("unique_places"),
        F.count_distinct("city").alias("n_cities"), F.bround(F.avg("avg_rating"), 3).alias("avg_activity_rating"))
    m = moves.groupBy("request_id").agg(
        F.count(ONE).alias("planned_days"),
        F.count_if(F.col("travel_level").isin("same_division", "cross_division")).alias("transfers"))
    j = wish.join(s, "request_id", "left").join(m, "request_id", "left").join(proof, "request_id", "left")
    covered = F.coalesce("covered", F.array().cast("array<string>"))
    return j.select(
        "request_id", "days", F.coalesce("planned_days", F.lit(0)).alias("planned_days"),
        F.coalesce("total_activities", F.lit(0)).alias("total_activities"), F.coalesce("unique_places", F.lit(0)).alias("unique_places"),
        F.coalesce("n_cities", F.lit(0)).alias("n_cities"), "avg_activity_rating",
        F.coalesce("evidence_reviews", F.lit(0)).alias("evidence_reviews"),
        F.array_join(F.array_sort(F.array_except("wanted", covered)), "|").alias("uncovered_preferences"),
        F.bround(F.try_divide(F.size(F.array_intersect("wanted", covered)), F.size("wanted")), 4).alias("preference_coverage"),
        F.coalesce("transfers", F.lit(0)).alias("transfers"))
