"""MinHash near-duplicates: banded candidates, signature batches with Bayesian pruning, exact verification.

A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence).
Documents of equal sets are one class. Classes sharing a band of their MinHash signature are candidates;
signature batches not used for banding are compared one after another, and a pair is dropped as soon as the
posterior probability of a similarity at or above the threshold falls under ``miss``. Survivors are compared by 32-bit
shingles where they meet, and what is within 0.01 of the threshold or above is confirmed on the full sets. With 25 bands of 4 a pair at exactly 0.75 shares no band with probability 7e-5, less above.

Null or wordless texts have the empty set: alone, kept. Rows with a null doc_id take part; their class then has the
smallest id that is not null, or none. Repeated rows are copies. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, connect, keyed, mix, packed, shingle_sets, slices, stored, unpacked

BANDS, ROWS, BATCH, BATCHES = 25, 4, 16, 4
BAND_HASHES = BANDS * ROWS
HASHES = BAND_HASHES + BATCH * BATCHES
MISS = 1e-6


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return (x[:n] >> np.uint64(32)).astype(np.uint32), (x[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_FLIP, _TIMES = _family(HASHES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, ((x[at : at + 1024][None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=low)
    return low


@lru_cache
def needed(threshold: float, miss: float) -> tuple[int, ...]:
    """Fewest matches after each batch that keep P(similarity >= threshold | matches) at or above ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at the threshold is the
    chance of at most m successes in n + 1 binomial trials.
    """
    out = []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``others`` whose signature is still in play after every batch, and their matches."""
    left, found = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, m in enumerate(least):
        lo = BAND_HASHES + k * BATCH
        found = found + (others[left, lo : lo + BATCH] == one[lo : lo + BATCH]).sum(axis=1)
        keep = found >= m
        left, found = left[keep], found[keep]
        if not len(left):
            break
    return left, found


class Tile:
    """Signatures of a tile's classes, and their shingles as numbers into the tile's own list."""

    def __init__(self, loads: list[bytes]):
        self.signatures = np.array([np.frombuffer(x[: 4 * HASHES], np.uint32) for x in loads])
        short = [np.frombuffer(x[4 * HASHES :], np.uint32) for x in loads]
        self.sizes = np.array([len(s) for s in short])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.numbers = np.unique(np.concatenate(short), return_inverse=True)[1]
        self.mark = np.zeros(self.numbers.max() + 1, np.int32)

    def similarity(self, i: int, at: np.ndarray) -> np.ndarray:
        """Jaccard similarity of row i with other rows, by one pass over their shingles."""
        own = self.numbers[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        if len(at) > 16:
            both = np.add.reduceat(self.mark[self.numbers], self.starts[:-1])[at]
        else:
            both = np.array([self.mark[self.numbers[self.starts[j] : self.starts[j + 1]]].sum() for j in at], np.int64)
        self.mark[own] = 0
        return both / (self.sizes[i] + self.sizes[at] - both)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for first, texts in slices(batch):
            sets = shingle_sets(texts)
            part = batch.slice(first, len(texts))
            yield arrow_rows(["doc_id", "_d", "_t", "n_shingles", "c", "load"], types, [
                part.column("doc_id"), part.column("_d"), part.column("_t"), [len(s) for s in sets],
                [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [signature(s).tobytes() if len(s) else None for s in sets]])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("load").to_pylist()), np.uint32).reshape(-1, HASHES)[:, :BAND_HASHES].astype(np.uint64)
        sig = sig.reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
        for r in range(ROWS):
            key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, :, r])
        ids = batch.column("c")
        for b in range(BANDS):
            yield arrow_rows(["bucket", "c"], [pa.int64(), pa.binary()], [np.ascontiguousarray(key[:, b]).view(np.int64), ids])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch):
            made = shingle_sets(texts)
            yield arrow_rows(["c", "s", "short"], [pa.binary(), pa.binary(), pa.binary()], [
                batch.column("c").slice(first, len(texts)), [s.tobytes() for s in made], [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in made]])


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """doc_id, _d, _t, n_shingles, component_id and kept for every row of (doc_id, text)."""
    rows = stored(keyed(docs).mapInArrow(_described, "doc_id long, _d long, _t long, n_shingles long, c binary, load binary"))
    classes = stored(rows.filter("c is not null").dropDuplicates(["c"]).select("c", "load", "_d", "_t"))
    members = classes.select("c", "load").mapInArrow(_banded, "bucket long, c binary")
    least = needed(percent / 100, miss)

    # Sets are made once, for the classes that share a band with another class; repeated rows give equal ones.
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = stored(members.join(shared, "bucket", "left_semi"))
    wanted = classes.select("c", "_d", "_t").join(members.select("c").distinct(), "c", "left_semi")
    sets = stored(keyed(docs).join(wanted, ["_d", "_t"]).select("c", "text").mapInArrow(_sets, "c binary, s binary, short binary"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("c").alias("a"), F.col("s").alias("sa"))
        right = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(exact, "a binary, b binary")

    def near(load: "Tile", i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, _ = survivors(load.signatures[i], load.signatures[at], least)
        share = load.similarity(i, at[kept])
        good = share >= percent / 100 - 0.01  # from 32-bit values; the full sets decide
        return kept[good], share[good]

    compact = sets.select("c", "short").join(classes.select("c", "load"), "c").select("c", F.concat("load", "short").alias("load"))
    linked = connect(members, compact, check, Tile, near)
    ids = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("m"))
    whole = ids.join(linked, "c", "left").select("c", F.coalesce("root", "c").alias("root"), "m")
    named = whole.select("c", "root").join(whole.groupBy("root").agg(F.min("m").alias("low")), "root").select("c", "low")
    component = F.coalesce("low", "doc_id")
    return rows.select("doc_id", "_d", "_t", "n_shingles", "c").join(named, "c", "left").select(
        "doc_id", "_d", "_t", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """The documents without near-duplicates: the row of the smallest id of each group stays, once."""
    good = near_duplicates(docs, percent, miss).filter("kept").select("_d", "_t").distinct()
    left = packed(docs).join(good, ["_d", "_t"], "left_semi")
    return unpacked(left.dropDuplicates(["_d", "_t"]), docs.columns)


def query(spark, folder: str) -> DataFrame:
    from roamlens.llm.common import read

    return near_duplicates(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
