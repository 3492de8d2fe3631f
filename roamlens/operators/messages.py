"""Intent and entity tagging of a table of visitor messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.operators.retrieval import containment_pairs
from roamlens.session import broadcast_if_measured, broadcast_if_small, cut_lineage

ONE = "*"  # counted rows
P = vocab.INTENT_PATTERNS


def _words(col, longer_than: int):
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col), F.lit("[a-z']+"), F.lit(0)),
                                     lambda w: F.length(w) > longer_than))


def _tokens(col):
    stop = F.array(*[F.lit(w) for w in vocab.MESSAGE_STOPWORDS])
    return F.array_except(_words(col, 2), stop)


def full_names(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """Places whose name, or its part before a bracket, stands in the message: score 100."""
    m = messages.select(F.col("message_id").alias("id"), F.lower("message").alias("text"))
    names = stats.select("place_id", F.lower("place_name").alias("n"))
    forms = names.select("place_id", F.explode(F.array_distinct(F.array(
        F.col("n"), F.trim(F.element_at(F.split("n", r" \("), 1))))).alias("term")).filter("term <> ''")
    terms = forms.groupBy("term").agg(F.min("term").alias("term_id")).select("term_id", "term")
    return containment_pairs(m, terms).join(forms.withColumnRenamed("term", "term_id"), "term_id").select(
        F.col("id").alias("message_id"), "place_id").distinct().withColumn("score", F.lit(100).cast("long"))


def _word_sets(words: DataFrame, by: str) -> DataFrame:
    """(``by``, ws, set): the words of each id in order, repeats of repeated ids too, and what stands for equal lists."""
    return words.groupBy(by).agg(F.sort_array(F.collect_list("w")).alias("ws")).withColumn("set", F.sha2(F.array_join("ws", " "), 256))


def place_matches(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """Places a message names: score 100 for the full name or its part before a bracket,
    else the number of shared words longer than three letters.

    Words are counted between different word sets: places whose names have the same words get the same score from messages that say the same of
    them. Only the result is a row per message and place; it is made where the places lie, in as many tasks as a shuffle has, whatever a word's share.
    """
    strong = cut_lineage(full_names(messages, stats))
    names = _word_sets(stats.select("place_id", F.explode(_words(F.lower("place_name"), 3)).alias("w")), "place_id")
    held = names.select("set", "ws").distinct().select("set", F.explode("ws").alias("w"))
    said = messages.select("message_id", F.explode(_tokens("message")).alias("w")).join(held.select("w").distinct(), "w", "left_semi")
    asked = cut_lineage(_word_sets(said, "message_id"))
    shared = asked.select(F.col("set").alias("m_set"), "ws").distinct().select("m_set", F.explode("ws").alias("w")).join(held, "w").groupBy("m_set", "set").agg(
        F.count(ONE).alias("score"))
    met = asked.select("message_id", F.col("set").alias("m_set")).join(shared, "m_set")
    many = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(many, "set", "slice")
    asking = met.select("message_id", "set", "score", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("slice"))
    places = names.select("place_id", "set", F.pmod(F.xxhash64("place_id"), F.lit(many)).cast("int").alias("slice"))
    weak = spread(asking).join(spread(places), ["set", "slice"]).select("message_id", "place_id", "score")
    return strong.unionByName(weak.join(broadcast_if_measured(strong.select("message_id", "place_id")), ["message_id", "place_id"], "left_anti"))


def best_places(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """(message_id, place_id, n_strong): the place that a message most likely means and how many it names in full.

    Order is score, reviews, id. Without a full name, places sharing two words or more are looked up under pairs of
    words, which few places have; a place of one shared word can lead only if it leads all places of that word, so one place per word is kept. A common word
    never meets messages with all its places.
    """
    order = F.struct((-F.col("score")).alias("s"), (-F.col("review_count")).alias("n"), F.col("place_id"))
    strong = full_names(messages, stats).join(stats.select("place_id", "review_count"), "place_id").groupBy("message_id").agg(
        F.min_by("place_id", order).alias("place_id"), F.count(ONE).alias("n_strong"))
    names = stats.select("place_id", "review_count", F.sort_array(_words("place_name", 3)).alias("w"))
    asked = messages.join(strong.select("message_id"), "message_id", "left_anti").select("message_id", F.sort_array(_tokens("message")).alias("w"))
    held = names.select(F.explode("w").alias("x")).distinct()
    known = asked.select("message_id", F.explode("w").alias("x")).join(held, "x").groupBy("message_id").agg(F.sort_array(F.collect_set("x")).alias("w"))

    def pairs(w):
        return F.explode(F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda b: F.concat_ws(" ", a, b)))))

    two = known.select("message_id", pairs(F.col("w")).alias("k")).join(names.select("place_id", "review_count", pairs(F.col("w")).alias("k")), "k")
    # n words in common are n (n - 1) / 2 pairs.
    several = two.groupBy("message_id", "place_id", "review_count").agg(F.count(ONE).alias("p")).withColumn(
        "score", ((1 + F.sqrt(1 + 8 * F.col("p"))) / 2).cast("long"))
    top = names.select("place_id", "review_count", F.explode("w").alias("x")).groupBy("x").agg(
        F.min_by(F.struct("place_id", "review_count"), F.struct((-F.col("review_count")).alias("n"), F.col("place_id"))).alias("t"))
    single = known.select("message_id", F.explode("w").alias("x")).join(top, "x").select("message_id", "t.place_id", "t.review_count", F.lit(1).cast("long").alias("score"))
    weak = several.select("message_id", "place_id", "review_count", "score").unionByName(single).groupBy("message_id").agg(
        F.min_by("place_id", order).alias("place_id"), F.lit(0).cast("long").alias("n_strong"))
    return strong.unionByName(weak)


def city_matches(messages: DataFrame, cities: DataFrame) -> DataFrame:
    m = messages.select(F.col("message_id").alias("id"), F.lower("message").alias("text"))
    terms = cities.select(F.lower("city").alias("term")).distinct().select(F.col("term").alias("term_id"), "term")
    hit = containment_pairs(m, terms)
    c = cities.groupBy(F.lower("city").alias("term_id")).agg(F.min("city").alias("city"), F.min("district").alias("district"))
    return hit.join(broadcast_if_small(c), "term_id").select(F.col("id").alias("message_id"), "city", "district")


def preference_matches(messages: DataFrame, preferences: DataFrame, places: DataFrame, cities: DataFrame,
                       stats: DataFrame) -> DataFrame:
    """Preferences sharing words with a message, apart from words that only name its places."""
    named = cities.select("message_id", F.explode(F.array("city", "district")).alias("name")).unionByName(
        places.filter("score >= 100").join(stats.select("place_id", "place_name"), "place_id").select(
            "message_id", F.col("place_name").alias("name")))
    used = named.select("message_id", F.explode(_words("name", 2)).alias("w")).distinct()
    want = messages.select("message_id", F.explode(_tokens("message")).alias("w")).join(used, ["message_id", "w"], "left_anti")
    want = want.select("message_id", T.singular(F.col("w")).alias("w")).distinct()
    stop = F.array(*[F.lit(w) for w in vocab.MESSAGE_STOPWORDS])
    blob = F.concat_ws(" ", "preference_label", "category", "subcategory", "preference_description")
    pw = preferences.select("preference_id", F.explode(F.array_distinct(F.transform(
        F.array_except(_words(blob, 3), stop), T.singular))).alias("w"))
    return want.join(broadcast_if_small(pw), "w").groupBy("message_id", "preference_id").agg(F.count(ONE).alias("overlap"))


def tag(messages: DataFrame, stats: DataFrame, cities: DataFrame, preferences: DataFrame) -> DataFrame:
    """One row per message: intent, best place, city, leading preferences, days, pace and kind."""
    cm = city_matches(messages, cities)
    fm = preference_matches(messages, preferences, full_names(messages, stats), cm, stats)
    p = best_places(messages, stats)
    c = cm.groupBy("message_id").agg(F.min("city").alias("city"))
    # A taxonomy-sized list per message, cut to its three leading ids.
    lead = F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("o"), F.col("preference_id").alias("p"))))
    f = fm.groupBy("message_id").agg(F.array_join(F.transform(F.slice(lead, 1, 3), lambda x: x["p"]), ",").alias("preferences"))
    j = (
        messages.select("message_id", F.lower(T.strip(F.col("message"))).alias("t"), F.size(_tokens("message")).alias("n_tokens"))
        .join(p, "message_id", "left").join(c, "message_id", "left").join(f, "message_id", "left")
    )
    says = lambda k: F.col("t").rlike(P[k])
    compare = says("compare") & (F.coalesce("n_strong", F.lit(0)) >= 2)
    strong = F.coalesce("n_strong", F.lit(0)) > 0
    trip = says("itinerary") & ~compare
    asked = F.regexp_extract("t", P["days"], 1)
    number = F.when(asked != "", F.try_to_number(asked, F.lit("9999999999")).cast("long"))
    days = (
        F.when(asked != "", F.greatest(F.lit(1), F.least(number, F.lit(vocab.MAX_TRIP_DAYS))).cast("int"))
        .when(says("weekend"), 2).when(says("week"), 7).otherwise(3))
    intent = (
        F.when(says("greeting") & (F.col("n_tokens") <= 3), "greeting").when(says("thanks") & (F.col("n_tokens") <= 4), "thanks")
        .when(trip, "itinerary").when(compare, "compare")
        .when(says("review") & F.col("place_id").isNotNull(), "reviews")
        .when(F.col("preferences").isNotNull() & ~(strong & ~says("recommend")), "recommend")
        .when(F.col("place_id").isNotNull(), "place_info").when(F.col("city").isNotNull(), "city_info")
        .when(says("recommend"), "recommend_general").when(F.length("t") >= 2, "search").otherwise("unknown"))
    kind = F.when(says("accommodation"), "accommodation").when(says("attraction"), "attraction")
    pace = F.when(says("relaxed"), "relaxed").when(says("packed"), "packed").otherwise("standard")
    return j.select(
        "message_id", intent.alias("intent"), "place_id", "city", "preferences", kind.alias("place_kind"),
        F.when(trip, days).alias("days"), F.when(trip, number).alias("asked_days"), F.when(trip, pace).alias("pace"))
