"""Quality rules: text statistics and robust outliers by minimum-covariance-determinant estimates.

Five statistics of a document (words, mean word length, symbols, repeated lines and repeated words per hundred words) are put on
log scales and rounded to 1/1024, so that all sums are exact integers and reruns agree. For each (language, source) the
estimate is the mean and covariance of the share ``SHARE`` of rows with the smallest distances: concentration steps from two
starts (quartiles; all rows), each one grouped pass over all rows, keeping the smaller determinant. Distances are sorted by
counting bins of 1/32 octave, so no group is sorted or collected. Covariances get a floor (``FLOOR``), as statistics are often
constant. Rows whose squared Mahalanobis distance is above the chi-square quantile ``TAIL`` are rejected.

Groups under ``MIN_ROWS`` are pooled in their language, then over all; where even these are fewer nothing is rejected. A
null language or source is a group of its own. Null and empty texts have no words and fail the base rule. Repeated rows and ties
are judged alike. Extra columns are ignored by the rules and kept by the filter. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import _FIVE, _SPACE, arrow_rows, keyed, mix, packed, read, slices, small_broadcast, stored, unpacked, word_hashes

FEATURES = 5
SHARE, STEPS, MIN_ROWS, TAIL, SCALE = 0.75, 5, 50, 0.9999, 1024
FLOOR = np.array([0.3, 0.1, 0.7, 0.7, 0.7])  # standard deviations below which a statistic is not resolved
PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BLANK = b" \t\n\x0b\x0c\r"


def counts_of(texts: list[bytes]) -> np.ndarray:
    """The five counts of every text."""
    h, at = word_hashes(texts)
    run = mix(sum((h[k : len(h) - 4 + k] * _FIVE[k] for k in range(5)), np.zeros(len(h) - 4, np.uint64))) if len(h) > 4 else h[:0]
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0] = np.diff(at)
    for i, t in enumerate(texts):
        a = np.frombuffer(t, np.uint8)
        out[i, 1] = np.count_nonzero(((a & 0xC0) != 0x80) & ~_SPACE[a])
        out[i, 2] = np.count_nonzero(_SYMBOL[a])
        lines = [x for x in t.split(b"\n") if x.strip(_BLANK)]
        out[i, 3] = len(lines) - len(set(lines))
        lo, n = at[i], at[i + 1] - at[i]
        if n > 5:
            _, where, many = np.unique(run[lo : lo + n - 4], return_inverse=True, return_counts=True)
            twice = many[where] > 1
            if twice.any():
                step = np.zeros(n + 1, np.int64)
                step[: n - 4] += twice
                step[5 : n + 1] -= twice
                out[i, 4] = np.count_nonzero(np.cumsum(step[:n]))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch):
            part = batch.slice(first, len(texts))
            keep = ["doc_id", "_d", "_t", "g"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, counts_of(texts).T)], names=keep + COUNTS)


def chi_square(x: float, k: int) -> float:
    """Distribution function with k degrees of freedom."""
    term = total = 1.0
    n = 1
    while term > 1e-15 * total:
        term *= x / (k + 2 * n)
        total += term
        n += 1
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0.0


def chi_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < q else (lo, mid)
    return hi


CUT = chi_quantile(TAIL, FEATURES)
CONSISTENT = SHARE / chi_square(chi_quantile(SHARE, FEATURES), FEATURES + 2)


def _scaled(x: Column) -> Column:
    return F.round(x * SCALE).cast("long")


def with_features(stats: DataFrame) -> DataFrame:
    per = F.lit(100.0) / F.greatest("n_words", F.lit(1))
    z = [F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))),
         F.log1p(F.col("n_symbols") * per), F.log1p(F.col("n_dup_lines") * per), F.log1p(F.col("n_repeat_words") * per)]
    return stats.withColumns({f"z{i}": _scaled(x) for i, x in enumerate(z)} | {
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})


def distance() -> Column:
    """Squared Mahalanobis distance from centre ``c`` with precision ``p`` (row by row)."""
    off = [F.col(f"z{i}") / SCALE - F.col("c")[i] for i in range(FEATURES)]
    return sum((F.col("p")[i * FEATURES + j] * off[i] * off[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, precision and determinant from exact sums."""
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            r = r._asdict()
            n = r["n"]
            c = np.array([int(r[f"s{i}"]) / n for i in range(FEATURES)])
            s = np.zeros((FEATURES, FEATURES))
            for i, j in PAIRS:
                s[i, j] = s[j, i] = int(r[f"q{i}{j}"]) / n - c[i] * c[j]
            s = CONSISTENT * s / SCALE**2 + np.diag(FLOOR**2)
            out.append((r["g"], r["start"], (c / SCALE).tolist(), np.linalg.inv(s).ravel().tolist(), float(np.linalg.det(s))))
        yield pd.DataFrame(out, columns=["g", "start", "c", "p", "det"])


KIND = "g string, start int, c array<double>, p array<double>, det double"


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(FEATURES)],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def robust_estimates(rows: DataFrame, groups: int) -> DataFrame:
    """(g, c, p): the minimum-determinant estimate of each group of rows (g, z0, z1, ...)."""
    q = rows.groupBy("g").agg(*[F.percentile(f"z{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(FEATURES)])
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / SCALE / 1.349, 2) + float(FLOOR[i] ** 2) for i in range(FEATURES)]
    quartiles = q.select("g", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] / SCALE for i in range(FEATURES)]).alias("c"),
                         F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i in range(FEATURES) for j in range(FEATURES)]).alias("p"),
                         F.lit(0.0).alias("det"))
    everything = rows.groupBy("g").agg(*_sums()).withColumn("start", F.lit(1)).mapInPandas(_estimates, KIND)
    now = stored(quartiles.unionByName(everything))
    totals = [c for c in ["n", *[f"s{i}" for i in range(FEATURES)], *[f"q{i}{j}" for i, j in PAIRS]]]
    for _ in range(STEPS):
        near = rows.join(small_broadcast(now, 2 * groups), "g").withColumn("bin", F.floor(F.log2(1 + 64 * F.greatest(distance(), F.lit(0.0))) * 32).cast("int"))
        bins = near.groupBy("g", "start", "bin").agg(*_sums())
        w = Window.partitionBy("g", "start")
        upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        inside = bins.withColumn("_all", F.sum("n").over(w)).withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter(
            F.col("_before") < F.ceil(F.col("_all") * SHARE))
        now = stored(inside.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in totals]).mapInPandas(_estimates, KIND))
    best = now.groupBy("g").agg(F.min_by(F.struct("c", "p"), F.struct("det", "start")).alias("e"))
    return stored(best.select("g", "e.c", "e.p"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, _d, _t, the five counts, base_failed, distance (squared; null: not estimated) and kept for every document."""
    group = F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    named_docs = docs.select("doc_id", "text", group.alias("g"))
    stats = stored(with_features(keyed(named_docs, "g").mapInArrow(
        _counted, "doc_id long, _d long, _t long, g string, " + ", ".join(f"{c} long" for c in COUNTS))))
    sizes = stats.filter("not base_failed").groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("lang", F.get_json_object("g", "$.lang"))
    small = F.col("n") < MIN_ROWS
    rest = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    named = stored(sizes.select("g", F.when(~small, F.col("g")).when(rest >= MIN_ROWS, F.to_json(F.struct(F.col("lang").alias("rest_of")))).otherwise("{}").alias("pool"), "n"))
    groups = named.count()
    rows = stats.join(small_broadcast(named.select("g", "pool"), groups), "g", "left").drop("g").withColumnRenamed("pool", "g")
    enough = named.groupBy("pool").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_ROWS).select(F.col("pool").alias("g"))
    fit = rows.filter("not base_failed").join(small_broadcast(enough, groups), "g", "left_semi")
    best = robust_estimates(fit, groups)
    out = rows.join(small_broadcast(best, groups), "g", "left").withColumn("distance", distance())
    return out.select("doc_id", "_d", "_t", *COUNTS, "base_failed", "distance",
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep."""
    bad = judge(docs).filter("not kept").select("_d", "_t").distinct()
    return unpacked(packed(docs).join(bad, ["_d", "_t"], "left_anti"), docs.columns)


def query(spark, folder: str) -> DataFrame:
    return judge(read(spark, folder, "documents")).drop("_d", "_t")
