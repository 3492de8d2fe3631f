"""Place, city, preference, language, evidence and coverage rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.operators.joins import recent_bound
from roamlens.session import broadcast_if_small, top_per_key

ONE = "*"  # counted rows


def _count(name: str = "review_count") -> Column:
    return F.count(ONE).alias(name)


def _avg(value: str, name: str, digits: int = 3) -> Column:
    return F.round(F.avg(value), digits).alias(name)


# ---- places and cities ---------------------------------------------------------------------
def place_stats(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counts and ratings per place; places without reviews stay."""
    g = reviews.groupBy("place_id").agg(
        _count(), _avg("review_rating", "avg_review_rating"),
        F.count_if(F.col("review_rating") >= 4).alias("positive_reviews"),
        F.count_if(F.col("review_rating") <= 2).alias("negative_reviews"),
        F.min("review_date").alias("first_review_date"), F.max("review_date").alias("last_review_date"))
    return places.join(g, "place_id", "left").fillna(0, ["review_count", "positive_reviews", "negative_reviews"])


def city_stats(places: DataFrame, reviews: DataFrame) -> DataFrame:
    per_place = reviews.groupBy("place_id").agg(
        F.count(ONE).alias("n"), F.sum("review_rating").alias("s"), F.count("review_rating").alias("c"))
    p = places.filter("city IS NOT NULL AND city <> ''").join(per_place, "place_id", "left")
    return p.groupBy("city", "district", "division").agg(
        F.count_distinct("place_id").alias("place_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("review_count"),
        F.round(F.try_divide(F.sum("s"), F.sum("c")), 3).alias("avg_review_rating"))


def dataset_overview(reviews: DataFrame, places: DataFrame, topics: DataFrame, preferences: DataFrame) -> DataFrame:
    """One row of totals from one pass over the reviews and one over each dimension."""
    r = reviews.agg(
        F.count(ONE).alias("total_reviews"), F.count_if(F.col("topic_id") >= 0).alias("clustered_reviews"),
        F.count_if((F.col("topic_id") < 0) | F.col("topic_id").isNull()).alias("outlier_reviews"),
        _avg("review_rating", "avg_rating"), F.min("review_date").alias("first_review_date"),
        F.max("review_date").alias("last_review_date"))
    return r.select(
        "*", places.agg(F.count(ONE)).scalar().alias("total_places"),
        places.agg(F.count_distinct(F.when(F.col("city") != "", F.col("city")))).scalar().alias("total_cities"),
        topics.agg(F.count_if(F.col("topic_id") >= 0)).scalar().alias("total_topics"),
        preferences.agg(F.count(ONE)).scalar().alias("total_preferences"))


def overview_long(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """The overview as (metric, value), with counts by source and language."""
    base = reviews.agg(F.count(ONE).cast("double").alias("total_reviews"),
                       F.count_distinct("place_id").cast("double").alias("unique_places"),
                       F.bround(F.avg("review_rating"), 3).alias("avg_rating"))
    rows = base.unpivot([], ["total_reviews", "unique_places", "avg_rating"], "metric", "value")
    cities = places.agg(F.count_distinct("city").cast("double").alias("value")).select(
        F.lit("unique_cities").alias("metric"), "value")
    def by(col, label):
        return reviews.groupBy(col).agg(F.count(ONE).cast("double").alias("value")).select(
            F.concat(F.lit(f"reviews_{label}_"), F.col(col)).alias("metric"), "value")
    return rows.unionByName(cities).unionByName(by("source", "source")).unionByName(by("detected_language", "language"))


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per source and rating, with the share inside the source."""
    g = reviews.groupBy("source", "review_rating").agg(_count())
    total = F.sum("review_count").over(Window.partitionBy("source"))
    return g.withColumn("pct_in_source", F.bround(F.col("review_count") / total, 4))


def temporal_volume(reviews: DataFrame, unit: str = "review_month") -> DataFrame:
    return reviews.filter(F.col(unit).isNotNull()).groupBy(unit, "source").agg(_count())


# ---- preferences ------------------------------------------------------------------------------
def _share(df: DataFrame, value: str, name: str) -> DataFrame:
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(name, F.bround(F.try_divide(F.col(value), total), 4))


def _mean4(column: str) -> Column:
    """The mean to four places, halves up, from exact sums of hundred-millionths: the order of rows does not show."""
    units = f"CAST(round({column} * 1e8D) AS bigint)"
    return F.expr(f"(2 * sum({units}) + 10000 * count({column})) div (20000 * count({column})) / 1e4D")


def preference_frequency(preferences: DataFrame, topic_map: DataFrame, topics: DataFrame) -> DataFrame:
    """Topics and reviews per preference; a topic with two preferences counts under both."""
    m = topic_map.join(broadcast_if_small(topics.select("topic_id", "review_count")), "topic_id", "left")
    g = m.groupBy("preference_id").agg(
        F.count_distinct("topic_id").alias("topic_count"), F.sum("review_count").alias("review_count"),
        _mean4("similarity").alias("avg_similarity"), F.min("confidence").alias("min_confidence"))
    out = preferences.select("preference_id", "preference_label", "category", "subcategory", "preference_type").join(
        g, "preference_id", "left").fillna(0, ["topic_count", "review_count"])
    return _share(out, "review_count", "review_share")


def preference_coverage(summary: DataFrame, coverage: DataFrame) -> DataFrame:
    g = summary.groupBy("preference_id").agg(
        F.count_distinct("topic_id").alias("mapped_topic_count"), F.sum("review_count").alias("covered_reviews"),
        F.bround(F.avg("similarity"), 4).alias("avg_similarity"))
    return g.join(broadcast_if_small(coverage.select("preference_id", "coverage_status", "coverage_action")),
                  "preference_id", "left")


def topic_cells(reviews: DataFrame) -> DataFrame:
    """Counts per (place, topic): the only shuffle of review rows the preference rollups need."""
    return reviews.filter("topic_id IS NOT NULL").groupBy("place_id", "topic_id").agg(
        F.count(ONE).alias("n"), F.sum("review_rating").alias("s"), F.count("review_rating").alias("c"))


def _preference_cells(reviews: DataFrame, places: DataFrame, topic_map: DataFrame, preferences: DataFrame,
                      columns: list[str]) -> DataFrame:
    m = topic_map.select("topic_id", "preference_id").join(
        broadcast_if_small(preferences.select("preference_id", "preference_label", "preference_type")), "preference_id")
    p = places.select("place_id", *[c for c in columns if c != "place_id"])
    return topic_cells(reviews).join(broadcast_if_small(m), "topic_id").join(broadcast_if_small(p), "place_id", "left")


def _totals() -> list[Column]:
    return [F.sum("n").alias("review_count"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 3).alias("avg_rating")]


def city_preferences(reviews: DataFrame, places: DataFrame, topic_map: DataFrame, preferences: DataFrame) -> DataFrame:
    """City x preference; a city's district and division are its smallest."""
    cells = _preference_cells(reviews, places, topic_map, preferences, ["city", "district", "division"])
    return cells.filter("city IS NOT NULL AND city <> ''").groupBy(
        "city", "preference_id", "preference_label", "preference_type").agg(
        F.min("district").alias("district"), F.min("division").alias("division"), *_totals())


def venue_preferences(reviews: DataFrame, places: DataFrame, topic_map: DataFrame, preferences: DataFrame) -> DataFrame:
    """Place x preference evidence."""
    names = ["place_name", "city", "category", "place_kind"]
    cells = _preference_cells(reviews, places, topic_map, preferences, names)
    return cells.groupBy("place_id", *names, "preference_id", "preference_label", "preference_type").agg(*_totals())


def mainstream_split(summary: DataFrame) -> DataFrame:
    g = summary.groupBy(F.coalesce("preference_type", F.lit("unmapped")).alias("preference_type")).agg(
        F.count_distinct("topic_id").alias("topic_count"), F.count_distinct("preference_id").alias("preference_count"),
        F.sum("review_count").alias("review_count"), F.bround(F.avg("similarity"), 4).alias("avg_similarity"),
        F.bround(F.avg("sdd"), 4).alias("mean_sdd"))
    return _share(g, "review_count", "review_share")


def mapping_quality(precision: DataFrame, coverage: DataFrame) -> DataFrame:
    """Counts and pass rates of both checks as (metric, value)."""
    d1 = precision.agg(
        F.count(ONE).cast("double").alias("direction1_total_topics"),
        F.count_if("low_similarity_flag").cast("double").alias("direction1_low_similarity_flags"),
        F.count_if("ambiguous_flag").cast("double").alias("direction1_ambiguous_flags"),
        F.bround(F.avg((F.col("precision_status") == "pass").cast("int")), 4).alias("direction1_pass_rate"))
    ok = F.col("coverage_status") == "adequate"
    d2 = coverage.agg(
        F.count(ONE).cast("double").alias("direction2_total_preferences"),
        F.count_if(F.col("coverage_status") == "under_coverage").cast("double").alias("direction2_under_coverage"),
        F.count_if(ok).cast("double").alias("direction2_adequate"),
        F.bround(F.avg(ok.cast("int")), 4).alias("direction2_adequate_rate"))
    return d1.unpivot([], d1.columns, "metric", "value").unionByName(d2.unpivot([], d2.columns, "metric", "value"))


def taxonomy_tree(frequency: DataFrame) -> DataFrame:
    """Category nodes with counts and nested subcategories; a taxonomy-sized table."""
    f = frequency.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"),
                         F.coalesce("subcategory", F.lit("General")).alias("subcategory"),
                         "preference_id", "preference_label", "preference_type", "topic_count", "review_count")
    leaf = F.struct("preference_id", "preference_label", "preference_type", "topic_count", "review_count")
    sub = f.groupBy("category", "subcategory").agg(
        F.sum("review_count").alias("review_count"), F.array_sort(F.collect_list(leaf)).alias("preferences"))
    return sub.groupBy("category").agg(
        F.sum("review_count").alias("review_count"),
        F.array_sort(F.collect_list(F.struct("subcategory", "review_count", "preferences"))).alias("subcategories"))


def taxonomy_counts(frequency: DataFrame) -> DataFrame:
    """Rolled-up counts of every level of the tree in one pass."""
    f = frequency.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"),
                         F.coalesce("subcategory", F.lit("General")).alias("subcategory"), "preference_id", "review_count")
    return f.rollup("category", "subcategory").agg(
        F.count("preference_id").alias("preferences"), F.sum("review_count").alias("review_count"))


# ---- language -----------------------------------------------------------------------------------
def language_mix(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    r = reviews.select("review_id", "review_rating")
    return labels.join(r, "review_id").groupBy("language_label", "language_method", "text_basis").agg(
        _count(), F.round(F.avg("language_confidence"), 3).alias("avg_confidence"), _avg("review_rating", "avg_rating"))


def language_share(labels: DataFrame, target: float = 0.2) -> DataFrame:
    """Share per label and whether Bangla and romanised Bangla together reach the target."""
    g = labels.groupBy("language_label").agg(_count())
    total = g.agg(F.sum("review_count")).scalar()
    bangla = g.agg(F.sum(F.when(F.col("language_label").isin("bn", "bn-latn", "mixed"), F.col("review_count")).otherwise(0))).scalar()
    return g.withColumn("share", F.round(F.col("review_count") / total, 4)).withColumn(
        "meets_target", bangla / total >= target)


def language_by_tag(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("detected_language", "platform_language_tag", "source").agg(_count())


# ---- evidence, attributes, links -----------------------------------------------------------------
def entity_evidence(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct reviews, places and divisions behind each entity.

    Mentions shrink to one row per (entity, review) first, so the distinct counts never
    gather an entity's mentions in one task.
    """
    pair = evidence.groupBy("entity_id", "review_id").agg(
        F.count(ONE).alias("m"), F.first("found_in_place").alias("place"),
        F.first("found_in_division").alias("division"), F.sum("review_rating").alias("s"),
        F.count("review_rating").alias("c"))
    g = pair.groupBy("entity_id").agg(
        F.sum("m").alias("n_mentions"), F.count(ONE).alias("n_reviews"),
        F.count_distinct("place").alias("n_found_in_places"), F.count_distinct("division").alias("n_divisions"),
        F.round(F.try_divide(F.sum("s"), F.sum("c")), 3).alias("avg_rating_of_host_reviews"))
    return entities.select("entity_id", "canonical_name", "entity_type", "n_variants").join(
        g, "entity_id", "left").fillna(0, ["n_mentions", "n_reviews", "n_found_in_places", "n_divisions"])


def place_attributes(mentions: DataFrame, entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per (host place, attribute entity) with its best example sentence.

    The example is the row smallest by (short, not recent, distance to 120 characters, review id, sentence). Mentions
    first become one row per (place, entity, review) with its nearest sentences, so reviews are plain counts and a
    much-mentioned pair combines before the shuffle.
    """
    since = recent_bound(reviews)
    r = reviews.select("review_id", "place_name", "district", "division", "review_date")
    m = (
        mentions.filter(F.col("entity_type").isin(vocab.ATTRIBUTE_TYPES)).join(r, "review_id")
        .filter("entity_id IS NOT NULL AND place_name IS NOT NULL")
        .withColumn("year", F.year("review_date"))
        .withColumn("recent", F.coalesce(F.col("review_date") >= since, F.lit(False)))
        .withColumn("len", F.length(F.coalesce("sentence", F.lit(""))))
    )
    closeness = F.struct(F.abs(F.col("len") - vocab.EXAMPLE_TARGET_LENGTH).alias("d"), F.col("sentence"))
    pair = ["place_name", "district", "division", "entity_id", "entity_type"]
    cells = m.groupBy(*pair, "review_id", "year", "recent").agg(
        F.count(ONE).alias("n"), F.min(F.when(F.col("len") >= 20, closeness)).alias("long"), F.min(closeness).alias("any"))

    def first(kind: str, cond: Column) -> Column:
        row = F.struct(F.col(f"{kind}.d"), F.col("review_id"), F.col(f"{kind}.sentence"), F.col("year"))
        return F.min(F.when(cond & F.col(kind).isNotNull(), row))

    always = F.lit(True)
    g = cells.groupBy(*pair).agg(
        F.count(ONE).alias("n_reviews"), F.sum("n").alias("n_mentions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_if("recent").alias("n_recent_reviews"),
        F.coalesce(first("long", F.col("recent")), first("long", always)).alias("long_ex"),
        F.coalesce(first("any", F.col("recent")), first("any", always)).alias("any_ex"))
    ex = F.coalesce("long_ex", "any_ex")
    return g.withColumn("ex", ex).join(
        broadcast_if_small(entities.select("entity_id", F.col("canonical_name").alias("name"))), "entity_id", "left"
    ).select("place_name", "district", "division", "entity_type", "entity_id", "name", "n_reviews", "n_mentions",
             "first_year", "last_year", "n_recent_reviews", F.col("ex.review_id").alias("example_review_id"),
             F.col("ex.sentence").alias("example_sentence"), F.col("ex.year").alias("example_year"))


def local_specialities(attributes: DataFrame, min_reviews: int = vocab.SPECIALITY_MIN_REVIEWS,
                       min_share: float = vocab.SPECIALITY_MIN_SHARE) -> DataFrame:
    """Foods whose reviews come mostly from one district. District ties go to the first name."""
    food = attributes.filter("entity_type = 'FOOD' AND district IS NOT NULL AND district <> ''")
    d = food.groupBy("entity_id", "name", "district", "division").agg(
        F.sum("n_reviews").alias("r"), F.count_distinct("place_name").alias("n_places"),
        F.min_by("example_sentence", F.struct((-F.col("n_reviews")).alias("n"), F.col("place_name"))).alias("example"))
    top = d.groupBy("entity_id", "name").agg(
        F.sum("r").alias("reviews_total"),
        F.min_by(F.struct("district", "division", "r", "n_places", "example"),
                 F.struct((-F.col("r")).alias("r"), F.col("district"))).alias("t"))
    return top.filter((F.col("reviews_total") >= min_reviews) & (F.col("t.r") / F.col("reviews_total") >= min_share)).select(
        "entity_id", "name", F.col("t.district").alias("district"), F.col("t.division").alias("division"),
        F.col("t.r").alias("reviews_in_district"), "reviews_total",
        F.bround(F.col("t.r") / F.col("reviews_total"), 3).alias("share"),
        F.col("t.n_places").alias("n_places"), F.col("t.example").alias("example_sentence"))


def speciality_places(specialities: DataFrame, attributes: DataFrame) -> DataFrame:
    """The places behind each speciality, one row each instead of a joined list."""
    a = attributes.select("entity_id", "district", "place_name", "n_reviews")
    return a.join(broadcast_if_small(specialities.select("entity_id", "district", "name")), ["entity_id", "district"])


def place_links(mentions: DataFrame, entities: DataFrame, reviews: DataFrame,
                min_reviews: int = vocab.MIN_INDEPENDENT_MENTIONS) -> DataFrame:
    """Pairs of places linked by enough reviews: one found in the other's review, or both named.

    A pair needs ``min_reviews`` reviews, so a name in fewer reviews can be in no qualifying
    pair and leaves before pairs are formed; this loses nothing. Pairs are formed only inside
    one review, over its distinct names.
    """
    names = entities.select("entity_id", F.col("canonical_name").alias("name"))
    m = mentions.filter("entity_type = 'PLACE'").join(broadcast_if_small(names), "entity_id")
    named = m.groupBy("review_id", "name").agg(F.max("sentence").alias("sentence"))
    support = named.groupBy("name").agg(F.count(ONE).alias("s")).filter(F.col("s") >= min_reviews)
    named = named.join(support.select("name"), "name", "left_semi").withColumn("key", F.lower("name"))
    host = reviews.filter("place_name IS NOT NULL").select("review_id", F.col("place_name").alias("host"))

    def ordered(a: str, b: str) -> list[Column]:
        first = F.lower(a) <= F.lower(b)
        return [F.when(first, F.col(a)).otherwise(F.col(b)).alias("place_a"),
                F.when(first, F.col(b)).otherwise(F.col(a)).alias("place_b")]

    found = named.join(host, "review_id").filter(F.lower("host") != F.col("key")).select(
        "review_id", *ordered("host", "name"), F.col("sentence").alias("ex"), F.lit(True).alias("hosted"))
    other = named.select("review_id", F.col("name").alias("name2"), F.col("key").alias("key2"))
    with_host = named.join(host.select("review_id"), "review_id", "left_semi")
    both = with_host.join(other, "review_id").filter("name < name2 AND key <> key2").select(
        "review_id", *ordered("name", "name2"), F.col("sentence").alias("ex"), F.lit(False).alias("hosted"))
    per_review = found.unionByName(both).groupBy("place_a", "place_b", "review_id").agg(
        F.bool_or("hosted").alias("f"), F.bool_or(~F.col("hosted")).alias("t"),
        F.min_by("ex", F.struct((~F.col("hosted")).alias("h"), F.col("ex"))).alias("ex"))
    return per_review.groupBy("place_a", "place_b").agg(
        F.count(ONE).alias("n_reviews"), F.count_if("f").alias("n_found_in"), F.count_if("t").alias("n_together"),
        F.min("review_id").alias("example_review_id"),
        T.squeeze(F.min_by("ex", F.col("review_id"))).alias("example_sentence"),
    ).filter(F.col("n_reviews") >= min_reviews)


def hubs(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("place_a").alias("place"), "n_reviews").unionByName(
        links.select(F.col("place_b").alias("place"), "n_reviews"))
    return ends.groupBy("place").agg(F.count(ONE).alias("links"), F.sum("n_reviews").alias("reviews"))


def lesser_known_links(links: DataFrame, gems: DataFrame) -> DataFrame:
    """Links with a candidate at one end that is not already well known; the first end wins."""
    level = gems.filter(F.col("visibility").isin("V0", "V1", "V2")).groupBy("canonical_name").agg(
        F.min("visibility").alias("v"))
    a = broadcast_if_small(level.select(F.col("canonical_name").alias("place_a"), F.col("v").alias("va")))
    b = broadcast_if_small(level.select(F.col("canonical_name").alias("place_b"), F.col("v").alias("vb")))
    j = links.join(a, "place_a", "left").join(b, "place_b", "left").filter("va IS NOT NULL OR vb IS NOT NULL")
    return j.withColumn("gem", F.when(F.col("va").isNotNull(), F.col("place_a")).otherwise(F.col("place_b"))).withColumn(
        "visibility", F.coalesce("va", "vb")).drop("va", "vb")


# ---- coverage -------------------------------------------------------------------------------------
def district_coverage(districts: DataFrame, reviews: DataFrame, mentions: DataFrame, queue: DataFrame) -> DataFrame:
    """Every district, also the empty ones, with how much data it has."""
    since = recent_bound(reviews)
    g = reviews.groupBy("district").agg(
        F.count_distinct("place_name").alias("places"), F.count(ONE).alias("reviews"),
        F.count_if(F.col("review_date") >= since).alias("recent_reviews"),
        F.count_if(F.col("detected_language").isin(vocab.COVERAGE_BANGLA_LABELS)).alias("bn"))
    hosted = mentions.select("review_id", "entity_id").join(reviews.select("review_id", "district"), "review_id")
    pairs = hosted.groupBy("district", "entity_id").agg(F.count(ONE).alias("m"))
    known = queue.select("entity_id", F.lit(1).alias("is_gem")).distinct()
    mg = pairs.join(broadcast_if_small(known), "entity_id", "left").groupBy("district").agg(
        F.sum("m").alias("mentions"), F.count_if(F.col("is_gem").isNotNull()).alias("gem_candidates"))
    n = F.col("reviews")
    status = F.when(n == 0, "no data").when((n < vocab.THIN_REVIEWS) | (F.col("places") < 2), "thin").otherwise("covered")
    filled = districts.select("district", "division").join(broadcast_if_small(g), "district", "left").join(
        broadcast_if_small(mg), "district", "left").fillna(
        0, ["places", "reviews", "recent_reviews", "mentions", "gem_candidates"])
    return filled.select(
        "district", "division", "places", "reviews", "recent_reviews",
        F.bround(F.try_divide(F.col("bn"), n), 3).alias("bangla_share"), "mentions", "gem_candidates",
        status.alias("status"))


def district_places(reviews: DataFrame) -> DataFrame:
    """Reviewed places of each district, one row per place."""
    return reviews.groupBy("district", "place_name").agg(F.count(ONE).alias("reviews"))


def coverage_by_division(table: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return table.groupBy("division").agg(
        F.count(ONE).alias("districts"), is_("no data").alias("no_data"), is_("thin").alias("thin"),
        is_("covered").alias("covered"), F.sum("reviews").alias("reviews"), F.sum("places").alias("places"))


def concentration(table: DataFrame, k: int = 3) -> DataFrame:
    """Share of the placed reviews held by the ``k`` largest districts."""
    total = table.agg(F.sum("reviews")).scalar()
    top = table.orderBy(F.desc("reviews"), F.asc("district")).limit(k)
    return top.agg(F.sum("reviews").alias("reviews_in_top"),
                   F.array_join(F.array_sort(F.collect_list("district")), "|").alias("top_districts")).withColumn(
        "top_share", F.bround(F.try_divide(F.col("reviews_in_top"), total), 3))


# ---- audience --------------------------------------------------------------------------------------
def audience(reviews: DataFrame) -> DataFrame:
    """Local or visitor per review: stated location first, then the language written in."""
    where = F.lower(T.strip(F.col("user_location")))
    where = F.when(where.isin("", "nan", "none", "null", "na", "n/a"), None).otherwise(where)
    lang = F.lower(T.strip(F.col("detected_language")))
    stated = where.isNotNull()
    home = where.isin(vocab.DOMESTIC_NAMES)
    return reviews.select(
        "review_id", "place_name", "source", "division",
        F.when(stated & home, "domestic").when(stated, "foreign")
        .when(lang.isin(vocab.DOMESTIC_LANGUAGES), "domestic").otherwise("unknown").alias("audience"),
        F.when(stated & home, "stated location is Bangladesh")
        .when(stated, F.concat(F.lit("stated location is "), T.strip(F.col("user_location"))))
        .when(lang.isin(vocab.DOMESTIC_LANGUAGES), F.concat(F.lit("wrote in "), lang))
        .otherwise("no location, and wrote in English").alias("basis"))


def audience_comparison(mentions: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Mentions per group and audience along several dimensions, with within-audience shares.

    One pass: each mention is unpivoted into its dimensions and counted per (dimension,
    group, audience) before any share is taken.
    """
    j = mentions.join(labels.select("review_id", "audience"), "review_id", "left")
    long = j.select(F.coalesce("audience", F.lit("unknown")).alias("audience"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("(none)")).alias("group")) for c in columns
    ])).alias("d")).select("audience", "d.dimension", "d.group")
    n = lambda a: F.count_if(F.col("audience") == a)
    g = long.groupBy("dimension", "group").agg(
        n("domestic").alias("domestic_mentions"), n("foreign").alias("foreign_mentions"),
        n("unknown").alias("unknown_mentions"))
    totals = g.groupBy("dimension").agg(F.sum("domestic_mentions").alias("td"), F.sum("foreign_mentions").alias("tf"))
    d, f = F.col("domestic_mentions"), F.col("foreign_mentions")
    return g.join(F.broadcast(totals), "dimension").select(
        "dimension", "group", "domestic_mentions", "foreign_mentions", "unknown_mentions",
        F.bround(F.try_divide(d, F.col("td")), 4).alias("domestic_share"),
        F.bround(F.try_divide(f, F.col("tf")), 4).alias("foreign_share"),
        ((d >= vocab.MIN_CELL) & (f >= vocab.MIN_CELL)).alias("comparable"))


# ---- place registry -------------------------------------------------------------------------------
def final_names(candidates: DataFrame) -> DataFrame:
    """One name per place: the longest; a tie goes to corpus (0), alias (1), list (2), then A-Z."""
    bare = T.strip(F.col("name"))
    g = candidates.groupBy("place_id").agg(
        F.min_by(bare, F.struct((-F.length(bare)).alias("l"), F.col("origin"), F.col("name"))).alias("final_name"),
        F.count_distinct(bare).alias("n"))
    return g.select("place_id", "final_name",
                    F.when(F.col("n") == 1, "only name").otherwise("longest of the names").alias("why"))


def name_conflicts(names: DataFrame) -> DataFrame:
    """Names, in comparison form, that belong to more than one place."""
    g = names.groupBy(T.norm_name(F.col("name")).alias("name_key")).agg(
        F.count_distinct("place_id").alias("n_places"), F.min("place_id").alias("first_place_id"))
    return g.filter("n_places > 1")


def water_level(places: DataFrame, quotas: DataFrame) -> DataFrame:
    """Reviews to collect per place: each division's quota split by sqrt(popularity) under caps.

    A place is full when the level reaches cap / weight. Ordering places by that ratio, the
    level is where the caps below it plus level x the weights above it equal the quota, so
    two running sums per division find it. Running sums are taken over ratio slices first,
    then inside a slice, so a division holding most places is not one task's work. What
    rounding leaves goes one each to the largest fractions.

    ``places`` holds (place_id, division, review_count, existing), ``quotas`` (division, quota).
    """
    cap = F.greatest(F.col("review_count") - F.col("existing"), F.lit(0)).cast("double")
    weight = F.sqrt(F.greatest(F.col("review_count"), F.lit(1)).cast("double"))
    p = (
        places.withColumn("cap", cap).withColumn("weight", weight).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("slice", F.floor(F.col("ratio") / 4))
    )
    live = p.filter("cap > 0")
    cells = live.groupBy("division", "slice").agg(F.sum("cap").alias("cs"), F.sum("weight").alias("ws"))
    before = Window.partitionBy("division").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("division")
    cells = cells.select(
        "division", "slice", F.coalesce(F.sum("cs").over(before), F.lit(0.0)).alias("c0"),
        F.coalesce(F.sum("ws").over(before), F.lit(0.0)).alias("w0"), F.sum("ws").over(everything).alias("wt"),
        F.sum("cs").over(everything).alias("ct"))
    inside = Window.partitionBy("division", "slice").orderBy("ratio", "place_id").rowsBetween(Window.unboundedPreceding, 0)
    run = live.join(broadcast_if_small(cells), ["division", "slice"]).join(F.broadcast(quotas), "division")
    run = (
        run.withColumn("goal", F.least(F.col("quota").cast("double"), F.col("ct")))
        .withColumn("c_to", F.col("c0") + F.sum("cap").over(inside))
        .withColumn("w_to", F.col("w0") + F.sum("weight").over(inside))
        .withColumn("full", F.col("c_to") + F.col("ratio") * (F.col("wt") - F.col("w_to")) <= F.col("goal") + 1e-9)
    )
    done = run.groupBy("division").agg(
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)).alias("fc"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))), F.lit(0.0)).alias("fw"))
    level = run.join(F.broadcast(done), "division").withColumn(
        "alloc", F.when(F.col("full"), F.col("cap")).otherwise(
            (F.col("goal") - F.col("fc")) * F.col("weight") / (F.col("wt") - F.col("fw"))))
    floors = level.withColumn("base", F.floor(F.col("alloc") + 1e-9)).withColumn(
        "frac", F.greatest(F.round(F.col("alloc") - F.col("base"), 9), F.lit(0.0)))
    left = floors.groupBy("division").agg((F.bround(F.max("goal"), 0) - F.sum("base")).cast("long").alias("left_over"))
    room = floors.filter("base < cap").join(F.broadcast(left), "division")
    bucket = F.floor((1 - F.col("frac")) * 1000)
    bc = room.groupBy("division", bucket.alias("fb")).agg(F.count(ONE).alias("n"))
    bc = bc.select("division", "fb", F.coalesce(F.sum("n").over(
        Window.partitionBy("division").orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    rank = F.row_number().over(Window.partitionBy("division", "fb").orderBy(F.desc("frac"), F.asc("place_id")))
    extra = room.withColumn("fb", bucket).join(F.broadcast(bc), ["division", "fb"]).withColumn(
        "at", F.col("n0") + rank).filter("at <= left_over").select("place_id", F.lit(1).alias("extra"))
    got = floors.select("place_id", "base").join(extra, "place_id", "left")
    return p.select("place_id", "division", "review_count", "existing").join(got, "place_id", "left").select(
        "place_id", "division", "review_count", "existing",
        (F.coalesce("base", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("target_new"))


def collection_tier(ask: Column, available: Column) -> Column:
    """The smallest tier holding the capped ask; the last tier beyond all."""
    want = F.greatest(F.lit(1), F.least(ask, F.greatest(available, F.lit(1))))
    tiers = vocab.COLLECTION_TIERS
    return reduce(lambda acc, t: acc.when(want <= t, t), tiers[1:], F.when(want <= tiers[0], tiers[0])).otherwise(tiers[-1])
