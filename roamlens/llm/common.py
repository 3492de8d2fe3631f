"""Helpers shared by the text operators: row keys, written tables, word hashes, buckets and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word of the contracts: a run of characters other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 19  # bytes of text hashed at once
TILE = 1024  # rows of a bucket compared in one piece
MASK = (1 << 64) - 1


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches; a temporary one only under a local master without the setting."""
    from roamlens.session import _ensure_checkpoint_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: later steps and lost executors start from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a key (_d, _t) that is never null; rows of one key have the same id and text.

    Only the named columns are taken along, so columns of other names cannot clash.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *[F.col(f"`{c}`") for c in more], *key_columns())


def key_columns() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_d"),
            F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("_t")]


def packed(docs: DataFrame) -> DataFrame:
    """All columns of the input as one struct ``row`` beside the key, whatever their names are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key_columns())


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The input's columns again, with ``text`` replaced when given."""
    return df.select(*[(text if c == "text" and text is not None else F.col("row").getField(c)).alias(c) for c in columns])


def arrow_rows(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def small_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the counted rows (a few hundred bytes each) are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of a batch as UTF-8, about ``limit`` bytes at a time; null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        b = t.as_py()
        b = b"" if b is None else b.encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


_PLAIN = bytes(0x30 if 0x30 <= i <= 0x39 else i if i == 0x0A or i > 0x7F or chr(i).isalpha() else 0x20 for i in range(256))


def normalise(text: str) -> list[bytes]:
    """The lines as UTF-8 in lower case, ASCII digits as 0, other ASCII marks as single spaces."""
    return [b" ".join(x.split()) for x in text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split(b"\n")]


# ---- vectorised hashing ---------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(size - 1, b & MASK, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and where the words of each text begin (one more at the end)."""
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    inside = ~_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(a) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, at


_FIVE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text with fewer words is one shingle."""
    h, at = word_hashes([t.lower() for t in texts])  # bytes.lower() touches A-Z only
    if len(h) >= size:
        run = sum((h[k : len(h) - size + 1 + k] * _FIVE[k] for k in range(size)), np.zeros(len(h) - size + 1, np.uint64))
        run = mix(run)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= size:
            out.append(np.unique(run[lo : hi - size + 1]))
        elif hi > lo:
            short = (h[lo:hi] * _FIVE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance by bit-parallel columns; limit + 1 as soon as it must be above the limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    same = _shared(a, b)
    a, b = a[same:], b[same:]
    same = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, d = full, 0, len(a)
    for left, ch in zip(range(len(b) - 1, -1, -1), b):
        eq = where.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        d += (ph & top > 0) - (mh & top > 0)
        if d - left > limit:
            return limit + 1
        ph = (ph << 1 | 1) & full
        pv = (mh << 1) & full | ~(xv | ph) & full
        mv = ph & xv
    return d


# ---- connected components -------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(c, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternating star rounds (each node links its larger neighbours, then its smaller ones, to the
    smallest); every round is written to the shared folder. Minima are combined before the shuffle
    and the hub's rows are joined, not collected, so a hub with very many links is no single task.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = stored(large.join(small, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a <> b").distinct())
        # Done when every node has one link and none that is linked to links on.
        ends = nxt.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(
            F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
        now = nxt
        if not open_.limit(1).count():
            break
    return now.select(F.col("a").alias("c"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("c"), F.col("b").alias("root")).distinct())


def connect(members: DataFrame, payload: DataFrame, check: Callable[[DataFrame], DataFrame], unpack: Callable[[list[bytes]], object],
            near: Callable[[object, int, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(c, root) of the classes linked inside the buckets of ``members`` (bucket, c).

    Never all pairs of a bucket. First the two classes of a bucket of two, and each class of a larger one and the smallest of all its
    buckets, meet, and ``check`` confirms (a, b) links exactly. Only buckets whose classes then still lie in several components go on: their rows with ``payload``
    (c, load) are dealt into tiles of bounded size. In two rounds each class outside a tile's largest component is
    checked against the likeliest class inside it and against the likeliest of all others, which joins a group of
    copies; in the last round against every class of another component that ``near`` lets through.
    After that each pair of a bucket is in one component or has been compared. ``near`` gets the unpacked loads of a tile, a
    row and the rows to compare it with, and returns the positions in these worth checking and their scores.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = stored(members.join(counts, "bucket").select("bucket", "c", "n"))
    lead = held.groupBy("bucket").agg(F.min("c").alias("lead"))
    led = held.join(lead, "bucket").filter("c <> lead")
    star = led.filter("n = 2").select("c", "lead").unionByName(led.filter("n > 2").groupBy("c").agg(F.min("lead").alias("lead"))).select(
        F.col("c").alias("a"), F.col("lead").alias("b")).distinct()
    links = stored(check(star))
    held = held.filter("n > 2")  # the one pair of a smaller bucket has been checked
    kind, root, grew = dict(members.dtypes)["c"], components(links), True
    for best in (True, True, False):
        if best and not grew:
            continue
        seen = held.join(root, "c", "left").select("bucket", "c", "n", F.coalesce("root", "c").alias("root"))
        mixed = seen.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
        rest = seen.join(mixed, "bucket").join(payload, "c").withColumn("_own", F.pmod(F.xxhash64("c"), tiles).cast("int")).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        units = rest.select(
            F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("unit"),
            (F.col("_own") < F.col("_other")).alias("side"), (F.col("_own") == F.col("_other")).alias("self"), "c", "root", "load")
        pairs = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_cross(unpack, near, best), f"a {kind}, b {kind}")
        new = stored(check(pairs.distinct()))
        grew = bool(new.limit(1).count())
        if grew:
            links = links.unionByName(new)
            root = components(links)
    return root


def _cross(unpack, near, best: bool):
    """Pairs of different components inside each unit: every one that is near, or only the best of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_unit(batches):
            ids, root = t.column("c").to_pylist(), t.column("root").to_pylist()
            number = {r: i for i, r in enumerate(dict.fromkeys(root))}
            group, load = np.array([number[r] for r in root]), unpack(t.column("load").to_pylist())
            alone, side = bool(t.column("self")[0].as_py()), np.array(t.column("side").to_pylist())
            a, b = [], []
            largest = int(np.argmax(np.bincount(group)))
            for i in range(len(ids)):
                if group[i] == largest if best else not (alone or side[i]):
                    continue
                other = group != group[i]
                if not alone:
                    other &= side != side[i]
                elif not best:
                    other[: i + 1] = False
                at = np.flatnonzero(other)
                if not len(at):
                    continue
                kept, score = near(load, i, at)
                if best and len(kept):
                    inside = np.flatnonzero(group[at[kept]] == largest)
                    kept = kept[[int(np.argmax(score)), *(inside[np.argmax(score[inside])] for _ in inside[:1])]]
                for j in at[kept]:
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
            if a:
                yield arrow_rows(["a", "b"], [t.schema.field("c").type] * 2, [a, b])

    return run


def by_unit(batches: Iterator[pa.RecordBatch], key: str = "unit") -> Iterator[pa.Table]:
    """Whole groups of consecutive equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
