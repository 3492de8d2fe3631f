"""Corpus preparation: cleaning, duplicates, names, validation and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import coarse_language, normalize_bangla
from roamlens.session import broadcast_if_small, first_per_key

ONE = "*"  # counted rows


# ---- cleaning and duplicates ---------------------------------------------------------------
def clean(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review_text_clean", T.clean_text(F.col("review_text")))


def drop_short(cleaned: DataFrame, minimum: int = vocab.MIN_CLEAN_LENGTH) -> DataFrame:
    return cleaned.filter(F.length("review_text_clean") >= minimum)


def first_by_id(reviews: DataFrame, order: str = "row_order") -> DataFrame:
    return first_per_key(reviews, ["review_id"], F.col(order))


def first_by_text(cleaned: DataFrame, order: str = "row_order") -> DataFrame:
    """The first row of each exact text.

    Copies combine on the map side, so a text copied over a third of the rows is cheap. Rows
    travel once, keyed by a 256-bit digest instead of the text itself.
    """
    keyed = cleaned.withColumn("_digest", F.sha2("review_text_clean", 256))
    return first_per_key(keyed, ["_digest"], F.col(order)).drop("_digest")


def new_rows(batch: DataFrame, corpus_ids: DataFrame) -> DataFrame:
    """Rows whose id the corpus does not hold yet."""
    return batch.join(corpus_ids.select("review_id"), "review_id", "left_anti")


def repeated_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Submissions whose fingerprint is already known."""
    a = texts.withColumn("fingerprint", T.fingerprint(F.col("review_text")))
    b = known.select(T.fingerprint(F.col("review_text")).alias("fingerprint")).distinct()
    return a.join(b, "fingerprint", "left_semi")


def repeats(texts: DataFrame) -> DataFrame:
    """Submissions whose fingerprint a submission of a smaller id has."""
    a = texts.withColumn("fingerprint", T.fingerprint(F.col("review_text")))
    firsts = a.groupBy("fingerprint").agg(F.min("submission_id").alias("_first"), F.max("submission_id").alias("_last")).filter("_first < _last")
    return a.join(firsts, "fingerprint").filter("submission_id > _first").drop("_first", "_last")


def preprocess(raw: DataFrame) -> DataFrame:
    """Ids once, clean, long enough, texts once, coarse language."""
    kept = first_by_text(drop_short(clean(first_by_id(raw))))
    return kept.withColumn("detected_language", coarse_language(F.col("review_text_clean"), F.col("review_language")))


def preprocess_stats(raw: DataFrame) -> DataFrame:
    """Rows in and out and drops per reason as (metric, value), from one grouped pass.

    One row per (id, first text) and one per distinct text are all that is counted, so the
    chain of drops needs two shuffles instead of one per reason.
    """
    once = clean(first_by_id(raw))
    flagged = once.select(F.sha2("review_text_clean", 256).alias("d"), F.length("review_text_clean").alias("n"))
    texts = flagged.groupBy("d").agg(F.max("n").alias("n"), F.count(ONE).alias("c"))
    long = F.col("n") >= vocab.MIN_CLEAN_LENGTH
    sums = texts.agg(
        F.sum("c").alias("ids"), F.sum(F.when(~long, F.col("c")).otherwise(0)).alias("dropped_too_short"),
        F.sum(F.when(long, F.col("c") - 1).otherwise(0)).alias("dropped_duplicate_text"),
        F.count_if(long).alias("rows_out"))
    total = raw.agg(F.count(ONE)).scalar()
    wide = sums.select(total.alias("rows_in"), "rows_out", (total - F.col("ids")).alias("dropped_duplicate_id"),
                       "dropped_too_short", "dropped_duplicate_text")
    return wide.unpivot([], wide.columns, "metric", "value")


# ---- names ----------------------------------------------------------------------------------
def registry_names(registry: DataFrame) -> DataFrame:
    """(key, final name) for every known spelling; a later registry row wins a shared key."""
    names = registry.select("canonical_name", "list_order", F.explode(F.array_compact(F.concat(
        F.array("canonical_name", "list_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    return names.filter("n <> ''").groupBy(T.norm_name(F.col("n")).alias("name_key")).agg(
        F.max_by("canonical_name", "list_order").alias("by_name"))


def canonical_names(reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """Final place name: by external place id first, then by name, else unchanged."""
    ids = registry.select("canonical_name", F.explode(F.concat(
        F.array("place_ref"), F.coalesce("other_refs", F.array().cast("array<string>")))).alias("place_ref"))
    ids = ids.groupBy("place_ref").agg(F.max("canonical_name").alias("by_id"))
    return (
        reviews.withColumn("name_key", T.norm_name(F.col("place_name")))
        .join(broadcast_if_small(ids), "place_ref", "left").join(broadcast_if_small(registry_names(registry)), "name_key", "left")
        .withColumn("old_name", F.col("place_name"))
        .withColumn("place_name", F.coalesce("by_id", "by_name", "place_name")).drop("name_key", "by_id", "by_name"))


def renames(named: DataFrame) -> DataFrame:
    return named.filter("old_name <> place_name").select("old_name", "place_name").distinct()


def fill_coordinates(reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry coordinates where either is missing; an export's own pair is kept."""
    pts = registry.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.col("canonical_name").alias("place_name")).agg(
        F.max_by(F.struct(F.col("lat").alias("rlat"), F.col("lng").alias("rlng")), "list_order").alias("r"))
    gap = (F.col("lat").isNull() | F.col("lng").isNull()) & F.col("r").isNotNull()
    return reviews.join(broadcast_if_small(pts), "place_name", "left").withColumn("gap", gap).withColumn(
        "lat", F.when(F.col("gap"), F.col("r.rlat")).otherwise(F.col("lat"))).withColumn(
        "lng", F.when(F.col("gap"), F.col("r.rlng")).otherwise(F.col("lng"))).drop("gap", "r")


def apply_overrides(reviews: DataFrame, overrides: DataFrame, labels: list[str]) -> DataFrame:
    """Hand corrections by id; labels outside the vocabulary are not applied."""
    good = overrides.filter(F.col("label").isin(labels)).groupBy("review_id").agg(F.max("label").alias("override"))
    return reviews.join(broadcast_if_small(good), "review_id", "left").withColumn(
        "detected_language", F.coalesce("override", "detected_language")).drop("override")


def override_problems(reviews: DataFrame, overrides: DataFrame, labels: list[str]) -> DataFrame:
    bad = overrides.filter(~F.col("label").isin(labels)).select("review_id", F.lit("unknown label").alias("problem"))
    lost = overrides.join(reviews.select("review_id"), "review_id", "left_anti").select(
        "review_id", F.lit("unknown review").alias("problem"))
    return bad.unionByName(lost)


def downstream_gaps(reviews: DataFrame, topics: DataFrame, geography: DataFrame) -> DataFrame:
    """What a new batch leaves open: topics, geography and scale, as (gap, value)."""
    no_topic = reviews.join(topics.select("review_id"), "review_id", "left_anti").agg(F.count(ONE).alias("value")).select(
        F.lit("reviews_without_topic").alias("gap"), "value")
    blank = reviews.filter("city IS NULL OR trim(city) = ''").select("place_name").distinct().join(
        geography.select("place_name"), "place_name", "left_anti").agg(F.count(ONE).alias("value")).select(
        F.lit("places_without_geography").alias("gap"), "value")
    over = reviews.agg(F.count_if(F.col("review_rating") > 5).alias("value")).select(F.lit("ratings_over_5").alias("gap"), "value")
    return no_topic.unionByName(blank).unionByName(over)


# ---- submissions -------------------------------------------------------------------------------
def validate_submissions(subs: DataFrame, places: DataFrame) -> DataFrame:
    """Accepted, or the first reason not to be. Texts are cleaned before they are judged."""
    known = places.groupBy(F.lower("place_name").alias("name_key")).agg(F.min("place_name").alias("proper"))
    s = (
        subs.withColumn("body", T.clean_submission(F.col("review_text"))).withColumn("named", T.clean_submission(F.col("place_name")))
        .withColumn("area", T.clean_submission(F.col("district"))).withColumn("name_key", F.lower("named"))
        .join(broadcast_if_small(known), "name_key", "left")
    )
    links = F.regexp_count("body", F.lit("(?i)(?:https?://|www[.])"))
    chars = F.size(F.array_distinct(F.split(F.replace(F.col("body"), F.lit(" "), F.lit("")), "")))
    n, listed = F.length("body"), F.col("proper").isNotNull()
    reason = (
        F.when(F.col("rating").isNull() | ~F.col("rating").between(1, 5), "rating")
        .when(n < vocab.MIN_TEXT, "too-short").when(n > vocab.MAX_TEXT, "too-long")
        .when(links > vocab.MAX_LINKS, "links").when(chars < 6, "not-a-review")
        .when(listed, "accepted").when(~F.coalesce("is_new_place", F.lit(False)), "unknown-place")
        .when(~F.length("named").between(vocab.MIN_PLACE, vocab.MAX_PLACE), "place-name")
        .when(~F.length("area").between(vocab.MIN_DISTRICT, vocab.MAX_DISTRICT), "district").otherwise("accepted"))
    return s.select("submission_id", reason.alias("outcome"), F.coalesce("proper", "named").alias("place_name"),
                    (~listed & F.coalesce("is_new_place", F.lit(False))).alias("is_new_place"), n.alias("n_chars"))


# ---- place lists ---------------------------------------------------------------------------------
def validate_place_list(rows: DataFrame, divisions: list[str]) -> DataFrame:
    """Each listed row with its problem, if any, and its district split from the town."""
    lat, lng = F.expr("try_cast(latitude AS double)"), F.expr("try_cast(longitude AS double)")
    bare = T.strip(F.col("district"))
    town = F.regexp_extract(bare, r"^(.*?)\s*\(([^)]*)\)\s*$", 2)
    head = F.trim(F.regexp_extract(bare, r"^(.*?)\s*\(([^)]*)\)\s*$", 1))
    split = head != ""
    first = rows.groupBy("place_id").agg(F.min("row_order").alias("first_row"))
    problem = (
        F.when(~F.col("division").isin(divisions), "unknown division")
        .when((F.coalesce("name", F.lit("")) == "") | (F.coalesce("place_id", F.lit("")) == ""), "blank name or id")
        .when(F.col("lat").isNull() | F.col("lng").isNull(), "not a number").when(~S.in_box(F.col("lat"), F.col("lng")), "outside")
        .when(F.col("row_order") != F.col("first_row"), "repeated").otherwise("ok"))
    return rows.withColumn("lat", lat).withColumn("lng", lng).join(first, "place_id", "left").select(
        "place_id", "name", "row_order", problem.alias("outcome"), F.when(split, head).otherwise(bare).alias("district_clean"),
        F.when(split, F.trim(town)).otherwise(bare).alias("city"))


def known_names(reviews: DataFrame) -> DataFrame:
    """Rows and sources per place name, and its first known city and category."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_order"))).alias(c)
    return reviews.groupBy("place_name").agg(
        F.count(ONE).alias("n_rows"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        first("city"), first("category"))


def upsert_geography(geography: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry places into the geography: final names, coordinates win, blanks filled, rest added."""
    names = registry.select("place_ref", F.explode(F.array_compact(F.concat(
        F.array("canonical_name", "list_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    names = names.groupBy(T.norm_name(F.col("n")).alias("key")).agg(F.min("place_ref").alias("place_ref"))
    g = geography.withColumn("key", T.norm_name(F.col("place_name"))).join(broadcast_if_small(names), "key", "left").drop("key")
    r = registry.select("place_ref", "canonical_name", *[F.col(c).alias(f"r_{c}") for c in ("city", "district", "division", "lat", "lng")])
    j = g.join(r, "place_ref", "full_outer")
    blank = lambda c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"r_{c}"))
    new = F.col("place_name").isNull()
    return j.select(
        F.coalesce("canonical_name", "place_name").alias("place_name"), blank("city").alias("city"),
        blank("district").alias("district"), blank("division").alias("division"),
        F.coalesce("r_lat", "lat").alias("lat"), F.coalesce("r_lng", "lng").alias("lng"),
        F.when(new, "added").when(F.col("canonical_name").isNull(), "kept")
        .when(F.col("canonical_name") != F.col("place_name"), "renamed").otherwise("updated").alias("change"),
        F.coalesce((F.trim("division") != "") & (F.col("division") != F.col("r_division")), F.lit(False)).alias("division_conflict"))


# ---- health --------------------------------------------------------------------------------------
def corpus_health(reviews: DataFrame, places: DataFrame, divisions: DataFrame, min_place_reviews: int = 20,
                  min_division_places: int = 1) -> DataFrame:
    """Places, reviews and thin places per division, empty divisions included, with a verdict."""
    per_place = reviews.groupBy("place_id").agg(F.count(ONE).alias("n"))
    p = per_place.join(places.select("place_id", "division"), "place_id", "left")
    g = p.groupBy("division").agg(
        F.count(ONE).alias("places"), F.sum("n").alias("reviews"),
        F.count_if(F.col("n") < min_place_reviews).alias("thin_places"))
    out = divisions.select("division").join(broadcast_if_small(g), "division", "left").fillna(0, ["places", "reviews", "thin_places"])
    return out.withColumn("verdict", F.when(F.col("places") < min_division_places, "too few places")
                          .when(F.col("thin_places") > 0, "thin places").otherwise("ok"))


def duplicate_ids(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("review_id").agg(F.count(ONE).alias("copies")).filter("copies > 1")


def text_basis(reviews: DataFrame) -> DataFrame:
    """The reviewer's own words where kept, else the cleaned text."""
    own = F.when(T.strip(F.col("review_text_original")) != "", F.col("review_text_original"))
    return reviews.withColumn("text", F.coalesce(own, F.col("review_text_clean"))).withColumn(
        "text_basis", F.when(own.isNotNull(), "original").otherwise("clean"))


def merge_proposals(mined: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """New counts with old decisions; a recorded decision is never overwritten."""
    old = decided.select(*keys, F.col("decision").alias("old_decision"), F.col("reason").alias("old_reason"))
    return mined.join(old, keys, "full_outer").select(
        *keys, F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce("old_decision", F.lit("pending")).alias("decision"), F.coalesce("old_reason", F.lit("")).alias("reason"))


def normalized_key(surface):
    """Comparison form of a reviewed spelling."""
    return F.lower(normalize_bangla(surface))
