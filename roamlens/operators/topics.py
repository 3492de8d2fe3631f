"""Topics, vectors and the preference taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.operators import vectors as V
from roamlens.session import broadcast_if_small, cut_lineage, first_per_key, top_per_key

ONE = "*"  # counted rows


# ---- taxonomy tables -----------------------------------------------------------------
def best_two(scores: DataFrame, preferences: DataFrame, interpretations: DataFrame,
             tau: float = vocab.TAU_SIM) -> DataFrame:
    """Best and second best preference per topic from (topic_id, preference_id, similarity).

    At most two rows per topic leave each map task.
    """
    top = top_per_key(scores, ["topic_id"], [F.desc("similarity"), F.asc("preference_id")], 2)
    pair = top.groupBy("topic_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("preference_id"))).alias("preference_id"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("raw"),
        F.max(F.when(F.col("rank") == 2, F.col("preference_id"))).alias("p2"),
        F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("s2"),
    )
    prefs = preferences.select("preference_id", "category", "subcategory",
                               F.col("preference_label").alias("preference"))
    labels = interpretations.select("topic_id", "interpreted_label")
    return (
        pair.join(broadcast_if_small(prefs), "preference_id")
        .join(broadcast_if_small(labels), "topic_id", "left")
        .select(
            "topic_id", "interpreted_label", "preference_id", "category", "subcategory", "preference",
            F.bround("raw", 4).alias("similarity"),
            F.coalesce("p2", "preference_id").alias("second_best_preference_id"),
            F.bround(F.coalesce("s2", "raw"), 4).alias("second_best_similarity"),
            F.when(F.col("raw") >= tau, "high").otherwise("low").alias("confidence"),
            (F.col("raw") < tau).alias("needs_review"), F.lit(tau).alias("tau_sim"),
        )
    )


def precision_checks(mapping: DataFrame) -> DataFrame:
    gap = F.bround(F.col("similarity") - F.col("second_best_similarity"), 4)
    low, close = F.col("similarity") < vocab.TAU_SIM, F.col("sim_gap") < vocab.AMBIGUITY_MARGIN
    return (
        mapping.withColumn("sim_gap", gap)
        .withColumn("low_similarity_flag", low).withColumn("ambiguous_flag", close)
        .withColumn("precision_status",
                    F.when(low, "low_similarity").when(close, "ambiguous").otherwise("pass"))
    )


def secondary_mapping(precision: DataFrame) -> DataFrame:
    """Runner-up preferences of topics too close to call."""
    near = F.expr("ambiguous_flag AND NOT low_similarity_flag") & (
        F.col("second_best_similarity") >= vocab.TAU_SIM)
    return precision.filter(near).select(
        "topic_id", F.col("second_best_preference_id").alias("preference_id"),
        F.col("second_best_similarity").alias("similarity"),
        F.col("preference_id").alias("primary_preference_id"),
        F.col("similarity").alias("primary_similarity"), "sim_gap", F.lit(2).alias("mapping_rank"),
    )


def topic_preference_map(mapping: DataFrame, secondary: DataFrame) -> DataFrame:
    """Rank 1 rows from the mapping, rank 2 rows for near ties."""
    first = mapping.select(
        "topic_id", F.lit(1).alias("mapping_rank"), "preference_id", "similarity",
        "second_best_preference_id", "second_best_similarity",
        F.bround(F.col("similarity") - F.col("second_best_similarity"), 4).alias("sim_gap"),
        "confidence", F.col("needs_review").cast("int").alias("needs_review"), "tau_sim")
    second = secondary.select(
        "topic_id", "mapping_rank", "preference_id", "similarity",
        F.col("primary_preference_id").alias("second_best_preference_id"),
        F.col("primary_similarity").alias("second_best_similarity"), "sim_gap",
        F.lit("medium").alias("confidence"), F.lit(1).alias("needs_review"),
        mapping.agg(F.max("tau_sim").alias("t")).scalar().alias("tau_sim"))
    return first.unionByName(second)


def coverage_checks(mapping: DataFrame, preferences: DataFrame, secondary: DataFrame) -> DataFrame:
    """Topics per preference, counting a topic under every preference it maps to."""
    primary = mapping.groupBy("preference_id").agg(F.count(ONE).alias("primary_topic_count"))
    every = mapping.select("topic_id", "preference_id").union(secondary.select("topic_id", "preference_id"))
    mapped = every.groupBy("preference_id").agg(F.count_distinct("topic_id").alias("mapped_topic_count"))
    n = F.col("mapped_topic_count")
    status = (F.when(n < vocab.MIN_TOPICS_PER_PREFERENCE, "under_coverage")
              .when(n > vocab.MAX_TOPICS_PER_PREFERENCE, "over_coverage").otherwise("adequate"))
    return (
        preferences.select("preference_id", "preference_label")
        .join(mapped, "preference_id", "left").join(primary, "preference_id", "left")
        .fillna(0, ["mapped_topic_count", "primary_topic_count"])
        .withColumn("coverage_status", status)
        .withColumn("coverage_action",
                    F.when(F.col("coverage_status") == "under_coverage", "merge_or_expand")
                    .when(F.col("coverage_status") == "over_coverage", "split").otherwise("no_action"))
    )


def recommendations(precision: DataFrame, coverage: DataFrame) -> DataFrame:
    """Issues found by both checks; one placeholder row when there are none."""
    p = precision.filter("precision_status <> 'pass'").select(
        F.lit("topic_precision_issue").alias("type"),
        F.concat(F.lit("topic_"), F.col("topic_id")).alias("target_id"),
        F.when(F.col("low_similarity_flag"), "high").otherwise("medium").alias("severity"),
        F.format_string("mapped %s sim=%.4f, second=%s sim=%.4f, gap=%.4f", "preference_id", "similarity",
                        "second_best_preference_id", "second_best_similarity", "sim_gap").alias("details"),
        F.lit("manual_remap_review").alias("suggested_action"))
    c = coverage.filter("coverage_status <> 'adequate'").select(
        F.lit("preference_coverage_issue").alias("type"), F.col("preference_id").alias("target_id"),
        F.lit("medium").alias("severity"),
        F.concat(F.lit("mapped_topic_count="), F.col("mapped_topic_count")).alias("details"),
        F.col("coverage_action").alias("suggested_action"))
    issues = p.unionByName(c)
    placeholder = issues.agg(F.count(ONE).alias("n")).filter("n = 0").select(
        F.lit("no_critical_issues").alias("type"), F.lit("all").alias("target_id"),
        F.lit("info").alias("severity"),
        F.lit("No low-similarity or coverage violations under current thresholds.").alias("details"),
        F.lit("expand_data").alias("suggested_action"))
    return issues.unionByName(placeholder)


def topic_dimension(summary: DataFrame, interpretations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Topics seen in the summary or in the reviews, with labels and corpus share."""
    counts = reviews.filter("topic_id IS NOT NULL").groupBy("topic_id").agg(F.count(ONE).alias("actual"))
    total = reviews.agg(F.greatest(F.count(ONE), F.lit(1)).alias("n")).scalar()
    labels = first_per_key(
        interpretations.select("topic_id", "interpreted_label", "interpretation", "dimension_hint"),
        ["topic_id"], F.struct("interpreted_label", "interpretation"))
    outlier = F.col("topic_id") == -1
    return (
        summary.join(counts, "topic_id", "full_outer").join(labels, "topic_id", "left")
        .select(
            "topic_id",
            F.coalesce("topic_name", F.when(outlier, "-1_outliers")).alias("topic_name"), "top_keywords",
            F.coalesce("review_count", "actual").alias("review_count"),
            F.bround(F.coalesce("review_count", "actual") / total, 4).alias("corpus_share"),
            F.coalesce("interpreted_label", F.when(outlier, "Unclustered (outliers)")).alias("interpreted_label"),
            "interpretation", "dimension_hint")
    )


def preference_dimension(classes: DataFrame, long_tail: DataFrame) -> DataFrame:
    """One row per preference; any long-tail topic makes its preference long tail."""
    once = first_per_key(classes, ["preference_id"], F.struct("category", "subcategory", "preference_label"))
    flags = long_tail.groupBy("preference_id").agg(F.bool_or("is_long_tail").alias("tail"))
    return once.join(broadcast_if_small(flags), "preference_id", "left").select(
        "preference_id", "category", "subcategory", "preference_label", "preference_description",
        F.when(F.col("tail"), "long_tail").otherwise(F.coalesce("preference_type", F.lit("mainstream")))
        .alias("preference_type"))


def fill_keywords(summary: DataFrame) -> DataFrame:
    """Blank keywords rebuilt from the topic name."""
    kept = T.blank_to_null(F.col("top_keywords"))
    return summary.withColumn(
        "top_keywords", F.coalesce(T.strip(kept), T.keywords_from_topic_name(F.col("topic_name"))))


def topic_summary(topics: DataFrame, mapping: DataFrame, long_tail: DataFrame, preferences: DataFrame) -> DataFrame:
    """Interpretation, mapping, flags and the three leading keywords in one row per topic."""
    words = F.filter(F.transform(F.split("top_keywords", ","), lambda w: F.trim(w)), lambda w: w != "")
    t = topics.select("topic_id", "topic_name", "top_keywords", "review_count", "interpretation",
                      "dimension_hint")
    m = mapping.select("topic_id", "interpreted_label", "preference_id", "category", "subcategory",
                       F.col("preference").alias("preference_label"), "similarity", "confidence",
                       "needs_review")
    lt = long_tail.select("topic_id", "preference_type", "sdd", "corpus_share")
    p = preferences.select("preference_id", "preference_description")
    return (
        t.join(broadcast_if_small(m), "topic_id").join(broadcast_if_small(lt), "topic_id")
        .join(broadcast_if_small(p), "preference_id", "left")
        .withColumn("summary_signals", F.array_join(F.slice(words, 1, 3), "; "))
    )


# ---- samples and place mix ---------------------------------------------------------------
def place_mix(reviews: DataFrame, top_n: int = 5) -> DataFrame:
    """``name (count); ...`` for the most reviewed places of each topic."""
    counts = reviews.groupBy("topic_id", F.coalesce("place_name", F.lit("unknown")).alias("place")).agg(
        F.count(ONE).alias("n"))
    top = top_per_key(counts, ["topic_id"], [F.desc("n"), F.asc("place")], top_n)
    item = F.struct("rank", F.concat(F.col("place"), F.lit(" ("), F.col("n"), F.lit(")")).alias("t"))
    return top.groupBy("topic_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("place_mix"))


def diverse_samples(reviews: DataFrame, max_items: int = 5) -> DataFrame:
    """Round-robin over a topic's places, most reviewed place first, at most ``max_items``.

    A place can give at most ``max_items`` texts, so a group limit inside (topic, place)
    loses nothing and keeps the second ranking small.
    """
    base = reviews.select("topic_id", F.coalesce("place_name", F.lit("unknown")).alias("place"),
                          "review_id", "review_text")
    sizes = base.groupBy("topic_id", "place").agg(F.count(ONE).alias("size"))
    turn = top_per_key(base.filter("review_text IS NOT NULL"), ["topic_id", "place"], [F.asc("review_id")],
                       max_items, "turn")
    ranked = top_per_key(turn.join(sizes, ["topic_id", "place"]), ["topic_id"],
                         [F.asc("turn"), F.desc("size"), F.asc("place")], max_items)
    return ranked.select("topic_id", "rank", "place", "review_id", T.shorten(F.col("review_text")).alias("sample"))


def keywords(docs: DataFrame, stop_words: list[str], top_n: int = 10) -> DataFrame:
    """Class-based TF-IDF keywords over one- and two-word terms.

    weight = tf * ln(1 + A / f): tf is the term's share inside the topic, f its count over
    all topics and A the mean number of terms per topic. Terms are counted per topic before
    anything is ranked, so a hot topic shrinks to its vocabulary on the map side.
    """
    # Stop words are passed over while words are taken out of the text.
    stop = "|".join(rf"\Q{w}\E" for w in sorted(stop_words, key=lambda w: (-len(w), w)))
    here = f"(?<![{T.WORD_CHARS}])" + (f"(?!(?:{stop})(?![{T.WORD_CHARS}]))" if stop else "")
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"{here}[{T.WORD_CHARS}]{{2,}}"), F.lit(0))
    two = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    terms = docs.select("topic_id", words.alias("w")).select(
        "topic_id", F.explode(F.concat("w", F.when(F.size("w") > 1, two).otherwise(F.array()))).alias("term"))
    tf = cut_lineage(terms.groupBy("topic_id", "term").agg(F.count(ONE).alias("n")))  # counted once, used four times
    per_topic = tf.groupBy("topic_id").agg(F.sum("n").alias("topic_terms"))
    mean_terms = per_topic.agg(F.avg("topic_terms").alias("a")).scalar()
    per_term = tf.groupBy("term").agg(F.sum("n").alias("all_n"))
    weight = F.col("n") / F.col("topic_terms") * F.ln(1 + mean_terms / F.col("all_n"))
    scored = tf.join(per_term, "term").join(broadcast_if_small(per_topic), "topic_id").withColumn(
        "weight", F.round(weight, 8))
    return top_per_key(scored, ["topic_id"], [F.desc("weight"), F.asc("term")], top_n).select(
        "topic_id", "rank", "term", "weight")


# ---- vectors ---------------------------------------------------------------------------------
def centroids(vectors: DataFrame, key: str = "topic_id", dims: int | None = None) -> DataFrame:
    """Mean unit vector per key, rescaled to unit length.

    Component sums are plain aggregates over (key, position): each map task sends one
    partial sum per component, however many vectors a key has.
    """
    parts = vectors.select(key, F.posexplode(S.unit(F.col("embedding"))).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg("x").alias("x"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(key, S.unit(F.transform("v", lambda s: s["x"])).alias("centroid"))


def _unit(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), S.unit(F.col(vector)).alias("u"))


def reassign_outliers(vectors: DataFrame, outlier: int = -1) -> DataFrame:
    """Outliers join the topic with the nearest centroid, equal ones by topic id; others keep theirs.

    Outliers meet the centroids block by block; the others meet their own centroid by a join on the topic.
    """
    cents = cut_lineage(centroids(vectors.filter(F.col("topic_id") != outlier)))
    lone = vectors.filter(F.col("topic_id") == outlier)
    best = V.nearest(_unit(lone, "vec_id", "embedding"), cents.select(F.col("topic_id").alias("id"), F.col("centroid").alias("u")), 1)
    moved = best.select(F.col("lid").alias("vec_id"), F.lit(outlier).cast(dict(vectors.dtypes)["topic_id"]).alias("topic_id_raw"), F.col("rid").alias("topic_id"),
                        F.lit("reassigned").alias("topic_assignment"), F.col("score").alias("topic_similarity"))
    kept = vectors.filter(F.col("topic_id") != outlier).join(broadcast_if_small(cents), "topic_id").select(
        "vec_id", F.col("topic_id").alias("topic_id_raw"), "topic_id", F.lit("cluster").alias("topic_assignment"),
        S.dot(S.unit(F.col("embedding")), F.col("centroid")).alias("topic_similarity"))
    return moved.unionByName(kept).withColumn("topic_similarity", F.round("topic_similarity", 6))


def cosine_scores(topics: DataFrame, preferences: DataFrame) -> DataFrame:
    """Cosine of every topic to every preference: (topic_id, preference_id, similarity)."""
    pairs = V.all_scores(_unit(topics, "topic_id", "vector"), _unit(preferences, "preference_id", "vector"))
    return pairs.select(F.col("lid").alias("topic_id"), F.col("rid").alias("preference_id"), F.col("score").alias("similarity"))


def nearest_preferences(topics: DataFrame, preferences: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` preferences most like each topic, with rank; the input of ``best_two`` without a row for every pair."""
    best = V.nearest(_unit(topics, "topic_id", "vector"), _unit(preferences, "preference_id", "vector"), k)
    return best.select(F.col("lid").alias("topic_id"), F.col("rid").alias("preference_id"), F.col("score").alias("similarity"), "rank")


def scarcity_cut(n_topics: Column) -> Column:
    """Share under which a topic is scarce: 2 %, or half the mean share when lower."""
    return F.when(n_topics <= 0, F.lit(vocab.SCARCITY_DEFAULT)).otherwise(
        F.least(F.lit(vocab.SCARCITY_DEFAULT), F.lit(0.5) / n_topics))


def min_topic_size(n_docs: Column) -> Column:
    return F.greatest(F.lit(6), F.bround(n_docs * 0.004, 0).cast("int"))


def long_tail_flags(topics: DataFrame, cut: float | None = None) -> DataFrame:
    """Scarce topics unlike every abundant one, from (topic_id, review_count, vector)."""
    stats = topics.agg(F.sum("review_count").alias("n"), F.count(ONE).alias("t"))
    total = stats.select("n").scalar()
    limit = F.lit(cut) if cut is not None else stats.select(scarcity_cut(F.col("t")).alias("c")).scalar()
    base = cut_lineage(topics.select("topic_id", "review_count", S.unit(F.col("vector")).alias("u"),
                                     (F.col("review_count") / total).alias("share"), limit.alias("cut")))
    sides = base.select(F.col("topic_id").alias("id"), "u", "share", "cut")
    best = V.nearest(sides.select("id", "u"), sides.filter("share >= cut").select("id", "u"), 1, other_only=True).select(
        F.col("lid").alias("topic_id"), F.col("score").alias("m"))
    scarce = F.col("share") < F.col("cut")
    return (
        base.join(best, "topic_id", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
        .select(
            "topic_id", "review_count", F.bround("share", 4).alias("corpus_share"), scarce.alias("scarce"),
            F.bround("m", 4).alias("max_sim_to_abundant"), F.bround(1 - F.col("m"), 4).alias("sdd"),
            F.lit(vocab.SDD_THRESHOLD).alias("sdd_threshold"), F.col("cut").alias("scarcity_threshold"),
            F.when(scarce & (1 - F.col("m") > vocab.SDD_THRESHOLD), "long_tail").otherwise("mainstream")
            .alias("preference_type"),
            (scarce & (1 - F.col("m") > vocab.SDD_THRESHOLD)).alias("is_long_tail"))
    )
