"""Embedding whitening by Chebyshev-filtered subspace iteration.

Each entry c of a vector becomes the integer x = floor(1024 c) + 100000. The covariance V is never formed: a pass over the
vectors gives VQ = Xᵀ(XQ) / n for a block Q of ``BLOCK`` columns, X centred row by row by the exact sums S before multiplying. Rows are packed once into blocks of
``ENTRIES`` integers in the shared folder; every pass reads them, adds one product per partition (BLOCK x dimension numbers) and sums these
in ``GROUPS`` tasks, so the driver gets ``GROUPS`` products at most, whatever the number of vectors.

One cycle: the polynomial recurrence of Chebyshev damps the eigenvalues in [0, smallest Ritz value] of the block, as V has none below 0; then
QR, one pass more, and Rayleigh-Ritz. The degree is the largest that keeps the gain of the largest eigenvalue within ``GAIN``, so no column drowns in the first component.
A component is certified when the residual of its pair is under ``TOLERANCE`` times its eigenvalue (or ``ROUNDING`` times the largest one), which bounds its angle by
residual / gap; it is then projected out of all later products, so the next ones get the whole gain. A component whose residual, under 1e-6 of its eigenvalue, gets no smaller in six cycles is at
its rounding; after ``PASSES`` passes all are taken as they are. ``residual``, the largest one over its eigenvalue, is the certificate that each row carries.

Rows are left out whose vector is null or holds null or non-finite entries (or entries beyond 2^40, whose x has no exact sums), and those whose length is not the most
frequent one (of equally frequent ones the larger), as there is no covariance between vectors of different lengths. Repeated rows and null ids stay as they are.
Of equal eigenvalues any basis is taken, the same for all rows. A component without variance has explained 0 and null whitened values. ``deviation`` is null where it passes a long. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from roamlens.llm.common import read, stored

COMPONENTS, BLOCK = 8, 32
TOLERANCE, ROUNDING, GAIN, DEGREE, PASSES = 1e-13, 1e-15, 1e8, 16, 1000
ENTRIES = 1 << 18  # integers of a block of rows
GROUPS = 32  # tasks that add up the partitions' products
SCALE, OFFSET = 1024, 100_000


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(1 << 40))


def blocks(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows of many vectors (ids, x as packed 64-bit integers), written to the shared folder, and the dimension."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", _finite))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = usual.d if usual else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, ENTRIES // width)):
                part = batch.slice(at, max(1, ENTRIES // width))
                v = part.column("v").flatten().to_numpy()
                x = np.floor(SCALE * v).astype(np.int64) + OFFSET
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    return stored(rows.filter(F.size("v") == width).mapInArrow(run, "ids array<long>, x binary")), width


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], width: int, like: np.ndarray) -> np.ndarray:
    """The sum over all blocks of ``make`` (block), an array like ``like``, added up per partition, then per group of partitions, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(like)
        for batch in batches:
            for x in batch.column("x"):
                total += make(np.frombuffer(x.as_py(), np.int64).reshape(-1, width))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(like)
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_py(), like.dtype).reshape(like.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("x").mapInArrow(partial, "g int, s binary").repartition(GROUPS, "g").mapInArrow(added, "s binary").collect()
    return sum((np.frombuffer(r.s, like.dtype).reshape(like.shape) for r in parts), np.zeros_like(like))


class Centre:
    """The exact centre S / n of the integers: a whole part and the rest over n."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.whole, self.rest = n, sums // n, sums % n

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        off = x - self.whole
        top = self.n * (int(np.abs(off).max()) + 1)
        if top * top * x.shape[1] < 1 << 63:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((off.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def centre(rows: DataFrame, width: int) -> Centre | None:
    def make(x: np.ndarray) -> np.ndarray:
        # Two halves of 26 bits, so that sums of more than 2^12 entries near 2^50 stay exact.
        return np.stack([np.append((x >> 26).sum(axis=0), len(x)), np.append((x & 0x3FFFFFF).sum(axis=0), 0)])

    high, low = summed(rows, make, width, np.zeros((2, width + 1), np.int64))
    n = int(high[-1])
    sums = np.array([(int(h) << 26) + int(v) for h, v in zip(high[:-1], low[:-1])], object)
    return Centre(n, sums) if n else None


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, damped: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V that is small on [0, damped], times q; vq is V q. Scaled to stay near 1 at ``top``."""
    half = damped / 2
    sigma = half / (top - half)
    twice = 2 / sigma
    old, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        nxt = 1 / (twice - sigma)
        old, now = now, (apply(now) - half * now) * (2 * nxt / half) - (sigma * nxt) * old
        sigma = nxt
    return now


def principal(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Largest eigenvalues, their unit vectors (columns), the largest residual over its eigenvalue and the number of passes."""
    q = np.linalg.qr(np.random.default_rng(SCALE).standard_normal((width, min(width, max(BLOCK, 2 * wanted)))))[0]
    done, values, residuals = np.zeros((width, 0)), np.zeros(0), np.zeros(0)
    passes, top, best, still = 0, 0.0, math.inf, 0

    def rest(x: np.ndarray) -> np.ndarray:
        """V x without the certified components."""
        nonlocal passes
        passes += 1
        y = apply(x)
        return y - done @ (done.T @ y)

    while True:
        vq = rest(q)
        h = q.T @ vq
        found, turn = np.linalg.eigh((h + h.T) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(top, float(found[0]))
        if top <= 0:
            return np.zeros(wanted), np.concatenate([done, q], 1)[:, :wanted], 0.0, passes
        off = np.linalg.norm(vq - q * found, axis=0)
        open_ = wanted - len(values)
        worst = float((off[:open_] / np.maximum(found[:open_], ROUNDING * top)).max())
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        good = off[:open_] <= np.maximum(TOLERANCE * found[:open_], ROUNDING * top)
        many = open_ if good.all() or (best < 1e-6 and still >= 6) or passes >= PASSES else int(np.argmin(good))
        if many:
            done, values = np.concatenate([done, q[:, :many]], 1), np.append(values, np.maximum(found[:many], 0.0))
            residuals = np.append(residuals, off[:many])
            q, vq, found, best, still = q[:, many:], vq[:, many:], found[many:], math.inf, 0
        if len(values) == wanted:
            order = np.argsort(-values, kind="stable")
            live = values > 1e-12 * top
            return values[order], np.linalg.qr(done[:, order])[0], float((residuals[live] / values[live]).max()), passes
        damped = max(float(found[-1]), 1e-6 * float(found[0]), ROUNDING * top)
        high = max(float(found[0]), damped * 1.0001)
        degree = max(2, min(DEGREE, int(math.log(GAIN) / math.acosh(2 * high / damped - 1))))
        q = filtered(rest, q, vq, high, damped, degree)
        q = np.linalg.qr(q - done @ (done.T @ q))[0]


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and residual for every vector and component."""
    kind = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows, width = blocks(vectors, key, column)
    middle = centre(rows, width)
    if middle is None:
        return vectors.sparkSession.createDataFrame([], kind)
    n, wanted = middle.n, min(components, width)
    middle.whole, middle.rest = middle.whole.astype(np.int64), middle.rest.astype(np.int64)

    def apply(q: np.ndarray) -> np.ndarray:
        def make(x: np.ndarray) -> np.ndarray:
            c = middle.rows(x)
            return c.T @ (c @ q)

        return summed(rows, make, width, np.zeros_like(q)) / n

    values, axes, residual, _ = principal(apply, width, wanted)
    live = values > 1e-12 * values[0] if values[0] > 0 else np.zeros(wanted, bool)
    turned = axes / np.sqrt(np.where(live, values, 1.0))

    def moments(x: np.ndarray) -> np.ndarray:
        """Products of the whitened values, their sums, and the variance."""
        c = middle.rows(x)
        z = c @ turned
        return np.concatenate([z.T @ z, z.sum(axis=0)[None], np.full((1, wanted), (c * c).sum())])

    m = summed(rows, moments, width, np.zeros((wanted + 2, wanted))) / n
    error = np.abs(m[:wanted] - np.outer(m[wanted], m[wanted]) - np.eye(wanted))[np.ix_(live, live)]
    identity_error, trace = float(error.max()) if error.size else 0.0, float(m[wanted + 1, 0])
    explained = np.where(live, values / trace if trace > 0 else 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column("ids"), batch.column("x")):
                x = np.frombuffer(packed.as_py(), np.int64).reshape(-1, width)
                z, many = middle.rows(x) @ turned, len(x)
                each = np.repeat(np.arange(many), wanted)
                dead = np.tile(~live, many)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(each)), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), many)), pa.array(np.full(many * wanted, n)),
                    pa.array(middle.deviation(x), pa.int64()).take(pa.array(each)), pa.array(z.ravel(), mask=dead), pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * wanted, identity_error)), pa.array(np.full(many * wanted, residual))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(run, kind)


def query(spark, folder: str) -> DataFrame:
    return whitened(read(spark, folder, "embeddings"))
