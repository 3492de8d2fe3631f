"""Listings, search, ranking, comparison and detail tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.similarity import half_even
from roamlens.session import broadcast_if_measured, broadcast_if_small, cut_lineage, top_per_key

ONE = "*"  # counted rows


def equals_ci(column: str, value: str | None) -> Column:
    """Case-insensitive equality; no value means no restriction."""
    return F.lit(True) if value is None else F.lower(column) == F.lower(F.lit(value))


def page(df: DataFrame, where: Column, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a filtered listing with the total of all matching rows.

    The sort keeps only ``offset + limit`` rows per task; ``order`` must end in a unique key.
    """
    hit = df.filter(where)
    total = hit.agg(F.count(ONE)).scalar()
    return hit.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def entity_page(entities: DataFrame, evidence: DataFrame, entity_type: str | None = None, min_reviews: int = 1, division: str | None = None,
                limit: int = 100, offset: int = 0) -> DataFrame:
    """Entities by how many distinct reviews back them; counts combine per (entity, review) before entities are joined."""
    per = evidence.groupBy("entity_id", "review_id").agg(F.count(ONE).alias("m"), F.bool_or(equals_ci("found_in_division", division)).alias("here"))
    counts = per.groupBy("entity_id").agg(F.sum("m").alias("n_mentions"), F.count(ONE).alias("n_reviews"), F.bool_or("here").alias("here"))
    rows = entities.drop("n_mentions", "n_reviews").join(counts, "entity_id", "left").fillna(0, ["n_mentions", "n_reviews"])
    where = (F.col("n_reviews") >= min_reviews) & equals_ci("entity_type", entity_type)
    if division is not None:
        where = where & F.coalesce("here", F.lit(False))
    return page(rows, where, [F.desc("n_reviews"), F.desc("n_mentions"), F.asc("canonical_name")], limit, offset).drop("here")


def mention_page(evidence: DataFrame, entity_id: str | None = None, entity_type: str | None = None, review_id: str | None = None, language: str | None = None,
                 found_in_place: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Grounded mentions with the review each comes from, by id."""
    where = equals_ci("entity_id", entity_id) & equals_ci("entity_type", entity_type) & equals_ci("review_id", review_id)
    if language is not None:
        where = where & equals_ci("language", language)
    if found_in_place is not None:
        where = where & F.contains(F.lower("found_in_place"), F.lit(found_in_place.lower()))
    return page(evidence, where, [F.asc("mention_id")], limit, offset)


# ---- containment of many terms in many texts -----------------------------------------------
def containment_pairs(texts: DataFrame, terms: DataFrame, long_piece: int = 12) -> DataFrame:
    """(id, term_id) where the text contains the term, without comparing every pair.

    A term occurring in a text brings all its pieces with it. Each term is filed under its
    rarest piece of a fixed length (12, 3, 2 or 1 characters by term length). A text sends only its id with those of its
    distinct pieces that some term has; texts come back, once per candidate term, for the final check.
    Both frames hold lower-case values: texts (id, text), terms (term_id, term).
    """
    n = F.length("term")
    size = F.when(n >= long_piece, long_piece).when(n >= 3, 3).when(n == 2, 2).otherwise(1)
    t = terms.filter(n > 0).withColumn("size", size)

    def pieces(col: str, width: Column) -> Column:
        # Cut into chunks first: a substring is found by counting from the start of its string.
        chunk = 512
        starts = F.sequence(F.lit(1), F.greatest(F.length(col) - width + 1, F.lit(1)), F.lit(chunk))
        chunks = F.transform(starts, lambda i: F.substring(F.col(col), i, width + chunk - 1))
        grams = F.flatten(F.transform(chunks, lambda c: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))), lambda i: F.substring(c, i, width))))
        return F.array_distinct(grams)

    wanted = t.select("term_id", "term", "size", F.explode(pieces("term", F.col("size"))).alias("piece"))
    sizes = F.array(*[F.lit(s) for s in (long_piece, 3, 2, 1)])
    every = texts.select("id", "text", F.explode(sizes).alias("size")).filter(F.length("text") >= F.col("size"))
    in_use = t.select("size").distinct()
    held = every.join(F.broadcast(in_use), "size", "left_semi").select("id", F.explode(pieces("text", F.col("size"))).alias("piece"))
    held = cut_lineage(held.join(wanted.select("piece").distinct(), "piece", "left_semi"))
    freq = held.groupBy("piece").agg(F.count(ONE).alias("df"))
    rare = wanted.join(freq, "piece", "left").groupBy("term_id", "term").agg(
        F.min_by("piece", F.struct(F.coalesce("df", F.lit(0)).alias("d"), F.col("piece"))).alias("piece"))
    likely = held.join(rare, "piece").select("id", "term_id", "term").distinct()
    return texts.select("id", "text").join(likely, "id").filter(F.contains("text", F.col("term"))).select("id", "term_id")


# ---- ranking ---------------------------------------------------------------------------------
CRITERIA = ["wanted", "city", "division", "place_kind", "exclude_cities", "min_reviews"]


def _matches(requests: DataFrame, stats: DataFrame, venue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, limit, sig) of the requests, and the scored places of each criteria set ``sig``.

    ``requests``: request_id, wanted (array), city, division, place_kind, exclude_cities
    (array), min_reviews, limit. Requests with equal criteria are ranked once. Wanted
    preferences meet the place x preference evidence by key; requests without any meet
    places by their filter values.
    """
    norm = requests.withColumn("wanted", F.array_sort(F.array_distinct(F.transform(
        F.coalesce("wanted", F.array().cast("array<string>")), F.upper))))
    signed = norm.withColumn("sig", F.sha2(F.to_json(F.struct(*CRITERIA), {"ignoreNullFields": "false"}), 256))
    crit = signed.select("sig", *CRITERIA).dropDuplicates(["sig"])
    p = stats.select("place_id", "place_name", "city", "district", "division", "category", "place_kind",
                     "review_count", F.col("avg_review_rating").alias("avg_rating"))
    ask = crit.select("sig", "wanted", *[F.col(c).alias(f"q_{c}") for c in CRITERIA[1:]])
    same = lambda c: F.col(f"q_{c}").isNull() | (F.lower(f"q_{c}") == F.lower(F.coalesce(c, F.lit(""))))
    outside = ~F.coalesce(F.exists("q_exclude_cities", lambda x: F.lower(x) == F.lower(F.col("city"))), F.lit(False))
    fits = same("city") & same("division") & same("place_kind") & outside & (F.col("review_count") >= F.col("q_min_reviews"))
    rating = F.coalesce("avg_rating", F.lit(0.0)) / 5.0

    # Places are few, but each meets every wish it allows: they lie by place in as many tasks as a shuffle has, and what they meet stays there.
    by_place = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place_id")
    cards = by_place(venue.select("place_id", F.upper("preference_id").alias("pref"), "preference_id",
                                  F.col("review_count").alias("n"))).join(broadcast_if_small(p), "place_id")
    need = broadcast_if_measured(ask.filter(F.size("wanted") > 0).withColumn("pref", F.explode("wanted")))
    hit = cards.join(need, "pref").filter(fits)
    share = F.col("matched_review_count") / F.col("review_count")
    keep = ["place_name", "city", "district", "division", "category", "place_kind", "review_count", "avg_rating"]
    by_wish = hit.groupBy("sig", "place_id", *keep).agg(
        F.array_sort(F.collect_set("preference_id")).alias("matched_preferences"),
        F.sum("n").alias("matched_review_count"), F.first(F.size("wanted")).alias("asked"))
    by_wish = by_wish.select(
        "sig", "place_id", *keep, "matched_preferences", "matched_review_count",
        half_even(share, 4).alias("evidence_share"),
        half_even(vocab.W_EVIDENCE * share + vocab.W_PREF_COVERAGE * F.size("matched_preferences") / F.col("asked")
                 + vocab.W_RATING * rating, 4).alias("match_score"))

    plain = ask.filter(F.size("wanted") == 0).select("*", *[
        F.coalesce(F.lower(f"q_{c}"), F.lit("*")).alias(f"k_{c}") for c in ("city", "division", "place_kind")])
    option = lambda c: F.array_distinct(F.array(F.lit("*"), F.coalesce(F.lower(c), F.lit("*"))))
    spread = by_place(p)
    for c in ("city", "division", "place_kind"):
        spread = spread.withColumn(f"k_{c}", F.explode(option(c)))
    volume = F.least(F.col("review_count") / 50.0, F.lit(1.0))
    by_rating = spread.join(broadcast_if_small(plain), ["k_city", "k_division", "k_place_kind"]).filter(fits).select(
        "sig", "place_id", *keep, F.array().cast("array<string>").alias("matched_preferences"),
        F.lit(0).cast("long").alias("matched_review_count"), F.lit(None).cast("double").alias("evidence_share"),
        half_even(0.75 * rating + 0.25 * volume, 4).alias("match_score"))

    return signed.select("request_id", "limit", "sig"), by_wish.unionByName(by_rating)


def matches(requests: DataFrame, stats: DataFrame, venue: DataFrame) -> DataFrame:
    """Every place that meets each request, scored and unranked."""
    signed, scored = _matches(requests, stats, venue)
    return signed.join(scored, "sig").drop("sig", "limit")


def recommend(requests: DataFrame, stats: DataFrame, venue: DataFrame) -> DataFrame:
    """The best ``limit`` places of each request (see ``_matches`` for its columns), ranked.

    No more places per criteria leave a task than the largest limit asked for.
    """
    signed, scored = _matches(requests, stats, venue)
    most = requests.agg(F.coalesce(F.max("limit"), F.lit(0)).alias("m")).first()["m"]  # one number
    top = top_per_key(scored, ["sig"], [F.desc("match_score"), F.desc("review_count"), F.asc("place_id")], int(most))
    return signed.join(top, "sig").filter("rank <= limit").drop("sig", "limit")


# ---- comparison -------------------------------------------------------------------------------
METRICS = [("avg_rating", True), ("review_count", True), ("positive_share", True), ("negative_share", False),
           ("preference_breadth", True), ("evidence_share", True)]


def compare_metrics(comparisons: DataFrame, stats: DataFrame, venue: DataFrame) -> DataFrame:
    """One row per comparison, metric and place, with the single leader (none on a tie).

    ``comparisons`` holds (compare_id, place_id) with two to four places each.
    """
    evidence = venue.groupBy("place_id").agg(F.count(ONE).alias("breadth"), F.sum("review_count").alias("mapped"))
    s = comparisons.join(stats, "place_id").join(evidence, "place_id", "left")
    n = F.col("review_count")
    rate = lambda c: F.bround(F.try_divide(F.coalesce(c, F.lit(0)), n), 4)
    wide = s.select(
        "compare_id", "place_id", F.col("avg_review_rating").cast("double").alias("avg_rating"),
        n.cast("double").alias("review_count"), rate(F.col("positive_reviews")).alias("positive_share"),
        rate(F.col("negative_reviews")).alias("negative_share"),
        F.coalesce("breadth", F.lit(0)).cast("double").alias("preference_breadth"), rate(F.col("mapped")).alias("evidence_share"))
    long = wide.unpivot(["compare_id", "place_id"], [m for m, _ in METRICS], "metric", "value")
    best = F.when(F.col("metric") == "negative_share", F.min("value").over(_per_metric())).otherwise(
        F.max("value").over(_per_metric()))
    marked = long.withColumn("is_best", F.coalesce(F.col("value") == best, F.lit(False)))
    alone = F.sum(F.col("is_best").cast("int")).over(_per_metric()) == 1
    return marked.select("compare_id", "metric", "place_id", "value", (F.col("is_best") & alone).alias("is_leader"))


def _per_metric() -> Window:
    return Window.partitionBy("compare_id", "metric")


def compare_preferences(comparisons: DataFrame, venue: DataFrame) -> DataFrame:
    """Preferences of the compared places: shared by all, or held by some."""
    size = comparisons.groupBy("compare_id").agg(F.count_distinct("place_id").alias("n_places"))
    held = comparisons.join(venue, "place_id").groupBy("compare_id", "preference_id").agg(
        F.count_distinct("place_id").alias("held_by"), F.sum("review_count").alias("review_count"))
    return held.join(size, "compare_id").withColumn(
        "scope", F.when(F.col("held_by") == F.col("n_places"), "shared").otherwise("distinct"))


def top_preference(comparisons: DataFrame, venue: DataFrame) -> DataFrame:
    return comparisons.join(venue, "place_id").groupBy("compare_id", "place_id").agg(F.min_by(
        "preference_label", F.struct((-F.col("review_count")).alias("n"), F.col("preference_id"))).alias("top_preference"))


def sample_reviews(spine: DataFrame, k: int = 2, min_length: int = 40) -> DataFrame:
    """The most substantial positive and critical reviews of each place."""
    base = spine.filter(F.col("text_length") > min_length).select("place_id", "review_id", "review_rating", "text_length")
    good = base.filter("review_rating >= 4").select(F.lit("positive").alias("side"), "*", (-F.col("review_rating")).alias("key"))
    bad = base.filter("review_rating <= 3").select(F.lit("critical").alias("side"), "*", F.col("review_rating").alias("key"))
    return top_per_key(good.unionByName(bad), ["place_id", "side"],
                       [F.asc("key"), F.desc("text_length"), F.asc("review_id")], k).drop("key")


# ---- search ----------------------------------------------------------------------------------
def _all_words(column: str, q: str) -> Column:
    words = [w for w in q.split() if len(w) >= 2] or [q]
    return reduce(lambda a, w: a & T.contains_any_form(F.col(column), F.lit(w)), words, F.lit(True))


def _has(column: str, q: str) -> Column:
    return T.contains_any_form(F.col(column), F.lit(q))


def search(q: str, frames: dict[str, DataFrame], per_kind: int = 5) -> DataFrame:
    """One query over every kind of thing, the best ``per_kind`` hits of each.

    Each kind is a filtered projection; only its best rows leave each task, so the cost is
    one scan per kind. ``frames`` may hold places, cities, things, gems, preferences, topics
    and reviews.
    """
    cols = ["kind", "id", "label", "score"]
    parts: list[DataFrame] = []

    def add(kind: str, df: DataFrame, id_: str, label: Column, score: Column, order: list[Column]) -> None:
        best = df.orderBy(*order, F.asc(id_)).limit(per_kind)
        parts.append(best.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), label.alias("label"),
                                 score.cast("double").alias("score")))

    if "places" in frames:
        p = frames["places"]
        where = _all_words("place_name", q) | _has("city", q)
        if "variants" in frames:
            # A place is also found by a spelling that resolves to an entity's name inside its own name.
            names = frames["variants"].filter((F.col("entity_type") == "PLACE") & _has("surface", q)).select(
                F.lower("canonical_name").alias("term")).distinct().withColumn("term_id", F.col("term"))
            named = containment_pairs(p.select(F.col("place_id").alias("id"), F.lower("place_name").alias("text")), names)
            p = p.join(named.select(F.col("id").alias("place_id")).distinct().withColumn("_alias", F.lit(True)), "place_id", "left")
            where = where | F.coalesce("_alias", F.lit(False))
        add("place", p.filter(where), "place_id", F.col("place_name"), F.col("review_count"), [F.desc("review_count")])
    if "cities" in frames:
        c = frames["cities"].filter(_has("city", q) | _has("district", q))
        add("city", c, "city", F.col("city"), F.col("review_count"), [F.desc("review_count")])
    if "things" in frames:
        for kind, entity_type in (("food", "FOOD"), ("activity", "ACTIVITY"), ("transport", "ACCESS")):
            t = frames["things"].filter((F.col("entity_type") == entity_type) & (F.col("n_places") > 0))
            t = t.filter(_all_words("canonical_name", q) | _has("spellings", q))
            add(kind, t, "entity_id", F.col("canonical_name"), F.col("n_reviews"), [F.desc("n_reviews")])
    if "gems" in frames:
        g, where = frames["gems"], _all_words("canonical_name", q)
        if "variants" in frames:
            spelled = frames["variants"].filter(_has("surface", q)).select("entity_id").distinct().withColumn("_alias", F.lit(True))
            g = g.join(spelled, "entity_id", "left")
            where = where | F.coalesce("_alias", F.lit(False))
        add("gem", g.filter(where), "entity_id", F.col("canonical_name"), F.col("gem_score"), [F.desc_nulls_last("gem_score")])
    if "preferences" in frames:
        pr = frames["preferences"].filter(_has("preference_label", q) | _has("preference_description", q) | _has("subcategory", q))
        add("preference", pr, "preference_id", F.col("preference_label"), F.col("review_count"), [F.desc("review_count")])
    if "topics" in frames:
        t = frames["topics"].filter(_has("interpreted_label", q) | _has("top_keywords", q) | _has("interpretation", q))
        add("topic", t, "topic_id", F.coalesce("interpreted_label", F.concat(F.lit("Topic "), "topic_id")),
            F.col("review_count"), [F.desc("review_count")])
    if "reviews" in frames:
        r = frames["reviews"].filter(_all_words("review_text", q))
        at = F.array_min(F.filter(F.array(*[
            F.locate(form.lower(), F.lower(T.squeeze(F.col("review_text")))) for w in (q.split() or [q]) for form in [w]
        ]), lambda x: x > 0))
        best = r.orderBy(F.desc(_has("review_text", q)), F.desc("review_rating"), F.length("review_text"),
                         F.asc("review_id")).limit(per_kind)
        parts.append(best.select(
            F.lit("review").alias("kind"), F.col("review_id").cast("string").alias("id"),
            T.snippet(T.squeeze(F.col("review_text")), F.coalesce(at, F.lit(0))).alias("label"),
            F.col("review_rating").cast("double").alias("score")))
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in parts])


# ---- details and listings -----------------------------------------------------------------------
def place_detail(stats: DataFrame, venue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Child rows of every place: preference evidence and rating breakdown, in long form.

    Long rows replace a nested list, so a place with most of the reviews is never one row.
    """
    pref = venue.select("place_id", F.lit("preference").alias("section"), F.col("preference_id").alias("item"),
                        F.col("review_count").alias("n"), F.col("avg_rating").alias("value"))
    rate = reviews.groupBy("place_id", "review_rating").agg(F.count(ONE).alias("n")).select(
        "place_id", F.lit("rating").alias("section"), F.col("review_rating").cast("string").alias("item"), "n",
        F.lit(None).cast("double").alias("value"))
    head = stats.select("place_id", F.lit("place").alias("section"), F.col("place_name").alias("item"),
                        F.col("review_count").alias("n"), F.col("avg_review_rating").alias("value"))
    return head.unionByName(pref).unionByName(rate)


def topic_places(reviews: DataFrame, places: DataFrame, k: int = 10) -> DataFrame:
    """Where a topic shows up: its most reviewed places."""
    g = reviews.filter("topic_id IS NOT NULL").groupBy("topic_id", "place_id").agg(
        F.count(ONE).alias("review_count"), F.round(F.avg("review_rating"), 3).alias("avg_rating"))
    top = top_per_key(g, ["topic_id"], [F.desc("review_count"), F.asc("place_id")], k)
    return top.join(broadcast_if_small(places.select("place_id", "place_name", "city")), "place_id")


def longest_reviews(spine: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The longest reviews of each topic or preference."""
    base = spine.filter(F.col(key).isNotNull()).select(key, "review_id", "place_id", "review_rating", "text_length")
    return top_per_key(base, [key], [F.desc("text_length"), F.asc("review_id")], k)


def preference_topics(topic_map: DataFrame, topics: DataFrame) -> DataFrame:
    t = topics.select("topic_id", "interpreted_label", "top_keywords", "review_count")
    return topic_map.select("preference_id", "topic_id", "mapping_rank", "similarity").join(broadcast_if_small(t), "topic_id")


def preference_leaders(rollup: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Cities or places where a preference is strongest."""
    return top_per_key(rollup, ["preference_id"], [F.desc("review_count"), F.asc(key)], k).select(
        "preference_id", "rank", key, "review_count", "avg_rating")


def evidence_list(evidence: DataFrame, k: int = 20, newest_first: bool = True) -> DataFrame:
    """The first ``k`` quoted mentions of every entity."""
    order = [F.desc_nulls_last("review_date")] if newest_first else [F.asc_nulls_first("found_in_place")]
    return top_per_key(evidence, ["entity_id"], [*order, F.asc("mention_id")], k).select(
        "entity_id", "rank", "mention_id", "surface", "review_id", "found_in_place", "review_date")


def found_in(evidence: DataFrame) -> DataFrame:
    pair = evidence.filter("found_in_place IS NOT NULL").groupBy("entity_id", "found_in_place", "review_id").agg(F.count(ONE).alias("x"))
    return pair.groupBy("entity_id", F.col("found_in_place").alias("place_name")).agg(F.count(ONE).alias("n_reviews"))


def offers(attributes: DataFrame, specialities: DataFrame) -> DataFrame:
    """Places offering a food, activity or transport, with the district it is a speciality of."""
    s = specialities.select("entity_id", F.col("district").alias("speciality_of"))
    return attributes.filter("entity_type IN ('FOOD', 'ACTIVITY', 'ACCESS')").select(
        "entity_id", "name", "entity_type", "place_name", "district", "n_reviews", "last_year", "n_recent_reviews",
        "example_sentence").join(broadcast_if_small(s), "entity_id", "left")


def attribute_cards(attributes: DataFrame) -> DataFrame:
    """Attributes with a flag on transport and tips that have no recent review."""
    stale = F.col("entity_type").isin(vocab.PERISHABLE_TYPES) & (F.col("n_recent_reviews") == 0)
    return attributes.select("place_name", "entity_type", "entity_id", "name", "n_reviews", "n_recent_reviews",
                             stale.alias("stale"))


def link_listing(links: DataFrame, gems: DataFrame, place_points: DataFrame) -> DataFrame:
    """Links with coordinates of both ends and the lesser-known end; a place beats a gem."""
    pts = place_points.filter("lat IS NOT NULL").select(F.lower("place_name").alias("k"), F.lit(0).alias("o"), "lat", "lng")
    gpt = gems.filter("lat IS NOT NULL").select(F.lower("canonical_name").alias("k"), F.lit(1).alias("o"), "lat", "lng")
    point = pts.unionByName(gpt).groupBy("k").agg(F.min_by(F.struct("lat", "lng"), F.struct("o", "lat", "lng")).alias("pt"))
    lesser = gems.filter(F.col("visibility").isin("V0", "V1", "V2")).groupBy(F.lower("canonical_name").alias("k")).agg(
        F.min("visibility").alias("v"))
    ends = point.join(lesser, "k", "full_outer")
    a = broadcast_if_small(ends.select(F.col("k").alias("ka"), F.col("pt").alias("pa"), F.col("v").alias("va")))
    b = broadcast_if_small(ends.select(F.col("k").alias("kb"), F.col("pt").alias("pb"), F.col("v").alias("vb")))
    j = links.withColumn("ka", F.lower("place_a")).withColumn("kb", F.lower("place_b")).join(a, "ka", "left").join(b, "kb", "left")
    return j.select(
        "place_a", "place_b", "n_reviews", "n_found_in", "n_together",
        F.when(F.col("va").isNotNull(), F.col("place_a")).when(F.col("vb").isNotNull(), F.col("place_b")).alias("lesser_known_place"),
        F.coalesce("va", "vb").alias("lesser_known_visibility"),
        F.col("pa.lat").alias("a_lat"), F.col("pa.lng").alias("a_lng"), F.col("pb.lat").alias("b_lat"), F.col("pb.lng").alias("b_lng"))


def filter_gems(gems: DataFrame, visibility: list[str] | None = None, division: str | None = None,
                freshness: str | None = None, state: str | None = None, hidden_only: bool = False,
                min_score: float = 0.0, mapped_only: bool = False) -> Column:
    """The register filters as one predicate."""
    where = F.coalesce("gem_score", F.lit(0.0)) >= min_score
    if visibility:
        where = where & F.col("visibility").isin([v.upper() for v in visibility])
    if division:
        where = where & F.exists("divisions", lambda d: F.contains(F.lower(d), F.lit(division.lower())))
    if freshness:
        where = where & (F.col("freshness") == freshness.lower())
    where = where & equals_ci("state", state)
    if hidden_only:
        where = where & (F.coalesce(F.col("already_official").cast("int"), F.lit(0)) == 0)
    if mapped_only:
        where = where & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return where
