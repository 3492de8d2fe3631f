"""Joins of vectors by blocks: every pair is scored, only what a left row asks for leaves the task.

Both sides are dealt into blocks of about ``BLOCK`` rows by a hash of their key. Each pair of a left and a right block is one matrix
product in one task, so a row is sent once per block of the other side (rows / ``BLOCK`` times) and memory is that of two
blocks and their product. No array holds a whole table and no (left, right) row is made unless all scores are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.session import top_per_key

BLOCK = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def over_blocks(left: DataFrame, right: DataFrame, emit: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], schema: str,
                block: int = BLOCK) -> DataFrame:
    """What ``emit`` (left rows, right rows, scores) returns for every pair of blocks.

    Both sides hold ``id`` and ``u``, an array of doubles, and may hold more columns. Scores are dot products, one row per
    left row. A side without rows gives no rows.
    """
    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return emit(a.slice(0, 0), b.slice(0, 0), np.zeros((0, 0)))
        return emit(a, b, _matrix(a.column("u")) @ _matrix(b.column("u")).T)

    return each_pair_of_blocks(left, right, meet, schema, block)


def each_pair_of_blocks(left: DataFrame, right: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK,
                        tasks: int | None = None) -> DataFrame:
    """What ``meet`` (left rows, right rows) returns for every pair of blocks; at most ``tasks`` tasks whatever the bytes, where given."""
    many = [max(1, -(-side.count() // block)) for side in (left, right)]
    dealt = [side.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        for side, own, other, n, m in ((left, "lb", "rb", many[0], many[1]), (right, "rb", "lb", many[1], many[0]))]
    if tasks:
        dealt = [side.repartition(min(many[0] * many[1], tasks), "lb", "rb") for side in dealt]
    return dealt[0].groupBy("lb", "rb").cogroup(dealt[1].groupBy("lb", "rb")).applyInArrow(meet, schema)


def all_scores(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lid, rid, score) for every pair."""

    def emit(a: pa.Table, b: pa.Table, s: np.ndarray) -> pa.Table:
        n, m = s.shape
        return pa.table({"lid": a.column("id").take(np.repeat(np.arange(n), m)), "rid": b.column("id").take(np.tile(np.arange(m), n)), "score": s.ravel()})

    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    return over_blocks(left, right, emit, f"lid {kinds[0]}, rid {kinds[1]}, score double", block)


def nearest(left: DataFrame, right: DataFrame, k: int, other_only: bool = False, block: int = BLOCK, ties: Column | None = None) -> DataFrame:
    """(lid, rid, score, rank): the ``k`` right rows with the largest scores per left row, equal scores by ``rid``.

    Each block pair gives its own best ``k`` and all that tie with the last of them; the best of these over all right blocks are taken by a ranked
    window that Spark limits before the shuffle. ``other_only``: a row is not near to the right row of its own id.
    """

    def emit(a: pa.Table, b: pa.Table, s: np.ndarray) -> pa.Table:
        n, m = s.shape
        if n and other_only:
            place = {v: j for j, v in enumerate(b.column("id").to_pylist())}
            own = [(i, place[v]) for i, v in enumerate(a.column("id").to_pylist()) if v in place]
            s[[i for i, _ in own], [j for _, j in own]] = -np.inf
        least = np.partition(s, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
        at, to = np.nonzero((s >= least[:, None]) & (s > -np.inf)) if n else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"lid": a.column("id").take(at), "rid": b.column("id").take(to), "score": s[at, to] if n else np.zeros(0)})

    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    best = over_blocks(left, right, emit, f"lid {kinds[0]}, rid {kinds[1]}, score double", block)
    return top_per_key(best, ["lid"], [F.desc("score"), F.asc("rid") if ties is None else ties], k)


def counts_above(left: DataFrame, right: DataFrame, margin: float = 1e-9, block: int = BLOCK) -> DataFrame:
    """(lid, higher): how many right rows score above the left row's ``own`` by more than ``margin``, added up over the blocks."""

    def emit(a: pa.Table, b: pa.Table, s: np.ndarray) -> pa.Table:
        own = a.column("own").to_numpy() if len(s) else np.zeros(0)
        return pa.table({"lid": a.column("id"), "higher": (s > own[:, None] + margin).sum(axis=1).astype(np.int64) if len(s) else np.zeros(0, np.int64)})

    per_block = over_blocks(left, right, emit, f"lid {dict(left.dtypes)['id']}, higher long", block)
    return per_block.groupBy("lid").agg(F.sum("higher").alias("higher"))
