"""Review samples, annotation pools and the sensitivity ladder.

Random choice is an order by a seeded hash, so every run and every partitioning agrees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import script_shares
from roamlens.operators import vectors as V
from roamlens.session import broadcast_if_small, top_per_key

ONE = "*"  # counted rows


def _hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mapping_sample(mapping: DataFrame, scores: DataFrame, target: int = 50, seed: int = 42) -> DataFrame:
    """Pairs to judge: mapped positives, runner-up challengers, hard and random negatives.

    A fifth of the target are positives and a fifth challengers of the same topics; half the
    rest are the most similar unmapped pairs, the others random. No negative is a mapping.
    """
    quota = max(1, round(target * 0.2))
    chosen = mapping.orderBy(_hash(seed + 1, "topic_id"), "topic_id").limit(quota)
    pos = chosen.select("topic_id", "preference_id", "similarity", F.lit("mapped_positive").alias("pair_type"), F.lit(1).alias("expected_relation"))
    cha = chosen.select("topic_id", F.col("second_best_preference_id").alias("preference_id"), F.col("second_best_similarity").alias("similarity"),
                        F.lit("second_best_challenger").alias("pair_type"), F.lit(0).alias("expected_relation"))
    used = pos.unionByName(cha)
    free = scores.join(mapping.select("topic_id", "preference_id"), ["topic_id", "preference_id"], "left_anti").join(
        used.select("topic_id", "preference_id"), ["topic_id", "preference_id"], "left_anti").select(
        "topic_id", "preference_id", F.bround("similarity", 4).alias("similarity"))
    topics = mapping.count()  # one number; decides how many rows the first two kinds take
    needed = max(0, target - 2 * min(quota, topics))
    hard = free.orderBy(F.desc("similarity"), "topic_id", "preference_id").limit(needed // 2)
    rest = free.join(hard.select("topic_id", "preference_id"), ["topic_id", "preference_id"], "left_anti")
    rand = rest.orderBy(_hash(seed, "topic_id", "preference_id"), "topic_id", "preference_id").limit(needed - needed // 2)
    neg = lambda df, kind: df.withColumn("pair_type", F.lit(kind)).withColumn("expected_relation", F.lit(0))
    return used.unionByName(neg(hard, "hard_negative")).unionByName(neg(rand, "random_negative"))


def topic_examples(reviews: DataFrame, k: int = 4, shortest: int = 60, longest: int = 420) -> DataFrame:
    """Up to ``k`` mid-length texts per topic, one per place first."""
    mid = reviews.filter(F.length("review_text").between(shortest, longest)).select("topic_id", "place_name", "review_id", "review_text")
    lead = mid.groupBy("topic_id", "place_name").agg(F.min("review_id").alias("review_id")).withColumn("later", F.lit(0))
    marked = mid.join(lead.select("topic_id", "place_name", "review_id", "later"), ["topic_id", "place_name", "review_id"], "left").fillna(1, ["later"])
    once = marked.groupBy("topic_id", F.sha2("review_text", 256).alias("d")).agg(
        F.min_by(F.struct("later", "review_id", "place_name", "review_text"), F.struct("later", "review_id")).alias("m")).select("topic_id", "m.*")
    return top_per_key(once, ["topic_id"], [F.asc("later"), F.asc("review_id")], k).drop("later")


def blinded_sheet(sample: DataFrame, examples: DataFrame, topics: DataFrame, preferences: DataFrame, annotator: str) -> DataFrame:
    """The sample without its answers, in an order of the annotator's own."""
    ex = examples.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "review_text"))), lambda x: x["review_text"]), " || ").alias("topic_examples"))
    key = F.concat_ws("|", F.col("topic_id").cast("string"), "preference_id")
    sheet = (
        sample.select("topic_id", "preference_id", key.alias("pair_key"))
        .join(broadcast_if_small(topics.select("topic_id", "top_keywords", "review_count")), "topic_id", "left").join(ex, "topic_id", "left")
        .join(broadcast_if_small(preferences.select("preference_id", F.concat_ws(" > ", "category", "subcategory").alias("preference_category"),
                                                    "preference_label", "preference_description")), "preference_id", "left")
    )
    # The sheet has the sample's few rows, so its order is one small sort.
    order = F.row_number().over(Window.orderBy(F.crc32(F.concat(F.lit(annotator), "pair_key").cast("binary")), "pair_key"))
    return sheet.withColumn("order", order)


def annotation_pool(reviews: DataFrame, size: int = 300, min_chars: int = 20, seed: int = 42) -> DataFrame:
    """Distinct Latin-script texts, one per (source, place) in turn, up to ``size``.

    No group can give more than ``size`` texts, so the turn ranking is cut there on the map side.
    """
    latin = reviews.filter((script_shares(F.col("text"))[1] > 0.8) & (F.length("text") >= min_chars))
    once = latin.groupBy(F.sha2("text", 256).alias("d")).agg(F.min_by(F.struct("review_id", "source", "place_name", "text"), "review_id").alias("m")).select("m.*")
    turn = top_per_key(once, ["source", "place_name"], [_hash(seed, "review_id"), F.asc("review_id")], size, "turn")
    return turn.orderBy("turn", "source", "place_name", "review_id").limit(size).drop("turn")


# ---- ladder --------------------------------------------------------------------------------------
def strata_quotas(reviews: DataFrame, fractions: list[float], stratum: str = "source") -> DataFrame:
    """(rung, stratum, quota): proportional, at least one, largest remainders first, exact total."""
    counts = reviews.groupBy(stratum).agg(F.count(ONE).alias("c"))
    total = counts.agg(F.sum("c")).scalar()
    rungs = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rung"), F.lit(f).alias("f")) for i, f in enumerate(fractions)]))
    q = counts.select(stratum, "c", rungs.alias("r"), total.alias("total")).select(
        stratum, "c", "r.rung", F.bround(F.col("r.f") * F.col("total"), 0).cast("long").alias("size"), "total")
    share = F.col("size") * F.col("c") / F.col("total")
    q = q.withColumn("base", F.least("c", F.greatest(F.floor(share), F.lit(1)))).withColumn("rest", share - F.floor(share))
    # One row per source and rung.
    rung = Window.partitionBy("rung")
    q = q.withColumn("open", F.col("size") - F.sum("base").over(rung))
    up = F.row_number().over(Window.partitionBy("rung").orderBy(F.desc(F.col("base") < F.col("c")), F.desc("rest"), F.asc(stratum)))
    down = F.row_number().over(Window.partitionBy("rung").orderBy(F.desc("base"), F.asc(stratum)))
    add = F.when((F.col("open") > 0) & (up <= F.col("open")) & (F.col("base") < F.col("c")), 1).when(
        (F.col("open") < 0) & (down <= -F.col("open")) & (F.col("base") > 1), -1).otherwise(0)
    return q.select("rung", stratum, (F.col("base") + add).alias("quota"), "size")


def ladder(reviews: DataFrame, fractions: list[float] = vocab.SAMPLE_FRACTIONS, stratum: str = "source", seed: int = 42) -> DataFrame:
    """(rung, review_id): nested samples, the lowest seeded hashes of each stratum.

    A source may hold most rows, so rows are never ranked per source. They fall into 4,096
    hash buckets; whole buckets are taken until the quota and only the last bucket is ranked.
    """
    h = reviews.select(stratum, "review_id", _hash(seed, "review_id").alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    sizes = h.groupBy(stratum, "bucket").agg(F.count(ONE).alias("n"))
    before = Window.partitionBy(stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    q = broadcast_if_small(strata_quotas(reviews, fractions, stratum))
    plan = sizes.join(q, stratum).filter("n0 < quota").select("rung", stratum, "bucket", (F.col("quota") - F.col("n0")).alias("room"), "n")
    got = h.join(broadcast_if_small(plan), [stratum, "bucket"])
    whole = got.filter("room >= n").select("rung", stratum, "review_id")
    w = Window.partitionBy("rung", stratum, "bucket").orderBy("h", "review_id")  # 1/4096 of a source
    part = got.filter("room < n").withColumn("at", F.row_number().over(w)).filter("at <= room").select("rung", stratum, "review_id")
    return whole.unionByName(part)


def sensitivity_metrics(mappings: DataFrame, n_preferences: Column) -> DataFrame:
    """Per rung: topics, coverage, mean similarity, confident share and Jaccard with the rung before.

    The preference set of a rung is taxonomy-sized.
    """
    g = mappings.groupBy("rung").agg(
        F.count_distinct("topic_id").alias("n_topics"), F.array_sort(F.collect_set("preference_id")).alias("ids"),
        F.bround(F.avg("similarity"), 4).alias("avg_similarity"),
        F.bround(F.avg((F.col("similarity") >= vocab.TAU_SIM).cast("int")), 4).alias("high_confidence_rate"))
    w = Window.orderBy("rung")  # a handful of rungs
    prev = F.lag("ids").over(w)
    j = F.size(F.array_intersect("ids", prev)) / F.size(F.array_union("ids", prev))
    return g.select(
        "rung", "n_topics", F.size("ids").alias("n_preferences_covered"), F.bround(F.size("ids") / n_preferences, 4).alias("coverage_rate"),
        "avg_similarity", "high_confidence_rate", F.bround(F.coalesce(j, F.lit(1.0)), 4).alias("jaccard_vs_previous"))


def stability_points(metrics: DataFrame, threshold: float = vocab.STABILITY_THRESHOLD) -> DataFrame:
    """The first stable rung by both rules: first to pass, and first from which all later pass."""
    w = Window.orderBy("rung")
    m = metrics.select("rung", (F.col("jaccard_vs_previous") >= threshold).cast("int").alias("ok"), F.row_number().over(w).alias("i"))
    m = m.withColumn("held", F.min("ok").over(w.rowsBetween(0, Window.unboundedFollowing)))
    later = F.col("i") > 1
    return m.agg(F.min(F.when(later & (F.col("ok") == 1), F.col("rung"))).alias("first_passing"),
                 F.coalesce(F.min(F.when(later & (F.col("held") == 1), F.col("rung"))), F.max("rung")).alias("stable_from"))


# ---- aligned pairs ---------------------------------------------------------------------------------
def aligned_pairs(reviews: DataFrame) -> DataFrame:
    """Bangla originals with their English translation, where the two really differ."""
    bn = script_shares(F.col("review_text_original"))[0]
    la = script_shares(F.col("review_text_clean"))[1]
    return reviews.filter((T.strip(F.col("review_text_original")) != "") & (F.col("review_text_original") != F.col("review_text_clean")) & (bn > 0.5) & (la > 0.8)).select(
        "review_id", "place_name", F.col("review_text_original").alias("bn"), F.col("review_text_clean").alias("en"))


def retrieval_accuracy(aligned: DataFrame, ks: tuple[int, ...] = (1, 5), block: int = V.BLOCK) -> DataFrame:
    """accuracy@k over aligned vectors (id, query, passage): is the own passage among the best k?

    Queries meet passages block by block and only a count per query leaves a task, so each vector is sent once per ``block`` rows
    of the other side and no (query, passage) row is made.
    """
    unit = aligned.select("id", S.unit(F.col("query")).alias("q"), S.unit(F.col("passage")).alias("p"))
    left = unit.select("id", F.col("q").alias("u"), S.dot(F.col("q"), F.col("p")).alias("own"))
    rank = V.counts_above(left, unit.select("id", F.col("p").alias("u")), block=block).select((F.col("higher") + 1).alias("rank"))
    return rank.agg(F.count(ONE).alias("n"), *[F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"acc_at_{k}") for k in ks])
