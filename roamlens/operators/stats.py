"""Agreement, rank, interval and exact statistics."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions.similarity import two_sided_p

ONE = "*"  # counted rows


def rank_tests(values: DataFrame, width: float = 256.0) -> DataFrame:
    """Rank-sum z and Mann-Whitney U of two groups per metric.

    ``values``: metric, grp ('a' or 'b'), value. Rows shrink to counts per distinct value; the
    mean rank of a value is what lies below it plus half its ties. What lies below is summed
    over buckets of values first and inside a bucket second, so no task sees all values.
    Metrics with an empty group give no row.
    """
    v = values.groupBy("metric", "value").agg(
        F.count_if(F.col("grp") == "a").alias("na"), F.count_if(F.col("grp") == "b").alias("nb")).withColumn("t", F.col("na") + F.col("nb")).withColumn(
        "bucket", F.floor(F.col("value") / width))
    b = v.groupBy("metric", "bucket").agg(F.sum("t").alias("bt"))
    before = Window.partitionBy("metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.select("metric", "bucket", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("metric", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    r = v.join(b, ["metric", "bucket"]).withColumn("below", F.col("b0") + F.coalesce(F.sum("t").over(inside), F.lit(0)))
    mean_rank = F.col("below") + (F.col("t") + 1) / 2
    cube = F.col("t").cast("double")
    s = r.groupBy("metric").agg(
        F.sum("na").alias("n1"), F.sum("nb").alias("n2"), F.sum(F.col("na") * mean_rank).alias("rank_sum"),
        F.sum(cube * cube * cube - cube).alias("ties")).filter("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    z = (F.col("rank_sum") - n1 * (n + 1) / 2) / F.sqrt(n1 * n2 * (n + 1) / 12)
    # The U test corrects its spread for ties and moves its statistic half a step inward.
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    mu = n1 * n2 / 2
    big = F.greatest(u, n1 * n2 - u)
    zu = F.when(sd > 0, (big - mu - 0.5) / sd)
    return s.withColumn("ranksums_z", z).withColumn("u_statistic", u).withColumn("u_z", zu).select(
        "metric", "n1", "n2", F.round("ranksums_z", 6).alias("ranksums_z"), "u_statistic", F.round("u_z", 6).alias("u_z"),
        F.round(two_sided_p("ranksums_z"), 6).alias("ranksums_p"), F.round(two_sided_p("u_z"), 6).alias("u_p"))


def retention(compared: DataFrame) -> DataFrame:
    """Share of what the original names that the translation still names, per type."""
    lost = F.col("outcome").startswith("lost")
    return compared.groupBy("entity_type").agg(
        F.count_if("in_original").alias("in_original"), F.count_if("in_translation").alias("in_translation"),
        F.count_if(F.col("outcome") == "kept").alias("kept"), F.count_if(lost).alias("lost"),
        F.count_if(F.col("outcome") == "only_in_translation").alias("only_in_translation"),
        F.round(F.avg(F.when(F.col("in_original"), F.col("in_translation").cast("double"))), 4).alias("retention"))


def bootstrap_interval(compared: DataFrame, samples: int = 2000, seed: int = 13) -> DataFrame:
    """95 % interval of retention, resampling whole reviews.

    Reviews with equal (named, kept) counts are interchangeable and make one cell. A resample of n reviews draws each cell a multinomial
    number of times, so a sample costs its cells, whatever the number of reviews. Samples are dealt over tasks in chunks, each with a
    generator seeded by type and chunk; a type's cells, bounded by the counts that a review can have, travel as one array.
    """
    found = compared.filter("in_original").groupBy("entity_type", "review_id").agg(
        F.count(ONE).alias("named"), F.count_if("in_translation").alias("kept"))
    kinds = found.groupBy("entity_type", "named", "kept").agg(F.count(ONE).alias("k"))
    cells = kinds.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("named", "kept", "k"))).alias("cells"))
    chunk = 100
    parts = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // chunk) - 1)))).repartition("entity_type", "part")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, part, cell in zip(*(batch.column(c) for c in ("entity_type", "part", "cells"))):
                kind, part = kind.as_py(), part.as_py()
                named, kept, k = np.array([list(c.values()) for c in cell.as_py()]).T
                size = min(chunk, samples - part * chunk)
                many = np.random.default_rng([seed, part, crc32(str(kind).encode())]).multinomial(k.sum(), k / k.sum(), size)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), pa.array(np.arange(size, dtype=np.int32) + part * chunk), pa.array((many @ kept) / (many @ named))],
                                                 names=["entity_type", "sample", "rate"])

    rate = parts.mapInArrow(draw, "entity_type string, sample int, rate double")
    at = F.row_number().over(Window.partitionBy("entity_type").orderBy("rate", "sample"))  # one value per sample
    ranked = rate.withColumn("at", at)
    pos = lambda k: F.max(F.when(F.col("at") == k, F.col("rate")))
    return ranked.groupBy("entity_type").agg(
        F.round(pos(int(0.025 * samples) + 1), 4).alias("low"), F.round(pos(int(0.975 * samples)), 4).alias("high"))


def visibility_sides(compared: DataFrame, levels: DataFrame) -> DataFrame:
    """Little-known and known places lost in translation or missing from the original's lists."""
    p = compared.filter("entity_type = 'PLACE'").join(levels.select("concept", "visibility"), "concept", "left")
    side = F.when(F.col("outcome").startswith("lost"), "lost_in_translation").when(
        F.col("outcome") == "only_in_translation", "missing_from_lists")
    return p.withColumn("side", side).filter("side IS NOT NULL").groupBy("side").agg(
        F.count_if(F.col("visibility").isin("V0", "V1")).alias("little_known"),
        F.count_if(F.col("visibility").isin("V0", "V1", "V2", "V3")).alias("rated"))


def _ln_factorial(n: Column) -> Column:
    """ln n!: the factorial itself up to 20, Stirling's series beyond."""
    x = n.cast("double")
    series = (x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def fisher_exact(tables: DataFrame, chunk: int = 50_000) -> DataFrame:
    """Two-sided exact p of 2x2 tables (table_id, a, b, c, d).

    The log probability of every cell value on the support is computed on its own, so a wide
    support is cut into chunks that are shuffled, scored and summed independently.
    """
    row1, col1 = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    t = tables.select("table_id", F.col("a").cast("long").alias("a"), row1.cast("long").alias("r"), col1.cast("long").alias("k"), total.cast("long").alias("n"))
    t = t.withColumn("low", F.greatest(F.lit(0), F.col("r") + F.col("k") - F.col("n"))).withColumn("high", F.least("r", "k"))
    f = _ln_factorial
    fixed = f(F.col("r")) + f(F.col("n") - F.col("r")) + f(F.col("k")) + f(F.col("n") - F.col("k")) - f(F.col("n"))

    def log_p(x: Column) -> Column:
        return F.col("fixed") - f(x) - f(F.col("r") - x) - f(F.col("k") - x) - f(F.col("n") - F.col("r") - F.col("k") + x)

    t = t.withColumn("fixed", fixed).withColumn("seen", log_p(F.col("a")))
    parts = t.withColumn("start", F.explode(F.expr(f"sequence(low, high, {chunk})"))).repartition("table_id", "start")
    x = parts.withColumn("x", F.explode(F.sequence("start", F.least("high", F.col("start") + chunk - 1)))).withColumn("l", log_p(F.col("x")))
    return x.groupBy("table_id").agg(F.round(F.least(F.lit(1.0), F.sum(
        F.when(F.col("l") <= F.col("seen") + 1e-7, F.exp("l")).otherwise(0.0))), 6).alias("p_two_sided"))


# ---- agreement ----------------------------------------------------------------------------------
def _band(k: Column) -> Column:
    return (
        F.when(k.isNull(), "undefined (no variation)").when(k < 0, "poor (below chance)").when(k <= 0.20, "slight").when(k <= 0.40, "fair")
        .when(k <= 0.60, "moderate").when(k <= 0.80, "substantial").otherwise("almost perfect"))


def complete_items(labels: DataFrame) -> DataFrame:
    """Labels of the items every annotator judged."""
    n = labels.agg(F.count_distinct("annotator")).scalar()
    full = labels.groupBy("pair_key").agg(F.count_distinct("annotator").alias("n")).filter(F.col("n") == n)
    return labels.join(full.select("pair_key"), "pair_key", "left_semi")


def cohen_kappa(labels: DataFrame) -> DataFrame:
    """Kappa, agreement and band per annotator pair, from a table of label pairs.

    Items become counts per (pair of annotators, label, label); annotators are few, so only
    that table is ever joined.
    """
    full = complete_items(labels)
    other = full.select("pair_key", F.col("annotator").alias("b"), F.col("label").alias("yb"))
    cell = full.select("pair_key", F.col("annotator").alias("a"), F.col("label").alias("ya")).join(other, "pair_key").filter("a < b").groupBy(
        "a", "b", "ya", "yb").agg(F.count(ONE).alias("n"))
    total = cell.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("ya") == F.col("yb"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"))
    ma = cell.groupBy("a", "b", F.col("ya").alias("y")).agg(F.sum("n").alias("xa"))
    mb = cell.groupBy("a", "b", F.col("yb").alias("y")).agg(F.sum("n").alias("xb"))
    pe = ma.join(mb, ["a", "b", "y"]).join(total.select("a", "b", "n"), ["a", "b"]).groupBy("a", "b").agg(
        F.sum(F.col("xa") / F.col("n") * (F.col("xb") / F.col("n"))).alias("pe"))
    j = total.join(pe, ["a", "b"], "left").fillna(0.0, ["pe"])
    k = F.when(F.col("pe") != 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return j.select(F.col("a").alias("annotator_a"), F.col("b").alias("annotator_b"), "n", F.round("po", 6).alias("raw_agreement"),
                    F.round(k, 6).alias("cohen_kappa"), _band(k).alias("interpretation"))


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """Fleiss' kappa over the items every annotator judged."""
    full = complete_items(labels)
    cell = full.groupBy("pair_key", "label").agg(F.count(ONE).alias("c"))
    item = cell.groupBy("pair_key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    pbar = item.agg(F.count(ONE).alias("n_items"), F.max("m").alias("raters"), F.avg(
        (F.col("sq") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("pbar"))
    per = full.groupBy("label").agg(F.count(ONE).alias("c"))
    total = per.agg(F.sum("c")).scalar()
    pe = per.agg(F.sum(F.pow(F.col("c") / total, 2))).scalar()
    j = pbar.withColumn("pe", pe)
    k = F.when(F.col("pe") != 1, (F.col("pbar") - F.col("pe")) / (1 - F.col("pe")))
    return j.select("n_items", "raters", F.round(k, 6).alias("fleiss_kappa"), _band(k).alias("interpretation"))


def consensus(labels: DataFrame) -> DataFrame:
    """Votes per item and the majority label; a tie has none."""
    full = complete_items(labels)
    g = full.groupBy("pair_key").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    return g.withColumn("consensus", F.when(F.col("yes") > F.col("no"), 1).when(F.col("no") > F.col("yes"), 0)).withColumn(
        "disagreement", (F.col("yes") > 0) & (F.col("no") > 0))


def binary_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy of (predicted, truth) per group."""
    hit = lambda p, t: F.count_if((F.col("predicted") == p) & (F.col("truth") == t))
    g = pairs.groupBy(*by).agg(F.count(ONE).alias("n"), hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*by, "n", "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                    F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"), F.round((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy"))


def share(df: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """Rows meeting a condition, their number and share; NULL on an empty group."""
    return df.groupBy(*by).agg(F.count(ONE).alias("n"), F.count_if(condition).alias("n_true"),
                               F.round(F.avg(condition.cast("int")), 4).alias("share"))
