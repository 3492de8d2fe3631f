"""Quality classifier: supervised subword embeddings.

A document's features are its lower-cased words, a mark for each word that repeats the one before it, and the character 3-, 4- and
5-grams inside the words (with word boundaries), hashed into ``ROWS`` vectors of ``DIM`` numbers. The vectors are averaged, a softmax layer reads the average, and both are learned by
stochastic gradient descent in numpy. Training runs in one task on a bounded sample of the labelled rows: up to ``PER_CLASS`` of
each class (and no more characters than ``SAMPLE_CHARS``), taken in hash order; the loss weighs the classes back to their shares.
As the layer is linear up to the softmax, a vector contributes one number to the score: scoring a document is one look-up per feature.

Whole texts are read. Null and empty texts have no feature and score the bias. Null labels are not learned from; with
no labels or one class only, every score is that class's share (0.5 without labels). Repeated rows and ties score alike. Null
ids are fine. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, keyed, mix, read, stored

ROWS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
PER_CLASS, SAMPLE_CHARS, EPOCHS, STEPS, RATE, SEED, REPEAT = 2500, 12_000_000, 8, 6000, 10.0, 7, 1
PIECE = 1 << 18  # characters hashed at once

_SPACES = np.zeros(0x110000, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def features(text: str) -> np.ndarray:
    """Hashed feature numbers of a text, repeats included."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _SPACES[c]
    c = np.where(blank, np.uint64(1), c.astype(np.uint64))  # one boundary mark
    x = mix(c * _TIMES)
    edge = np.flatnonzero(np.diff(blank))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    powers = np.cumprod(np.full(len(c), _TIMES, np.uint64))
    words = np.add.reduceat(np.append(x * powers, np.uint64(0)), np.stack([starts, ends], 1).ravel())[::2]
    # The same word has the same hash wherever it stands: divide by the power of its start.
    words = mix(words * _inverse(powers, starts)) >> np.uint64(47)
    again = np.full(np.count_nonzero(words[1:] == words[:-1]), REPEAT, np.uint64)
    out = [words, again]
    inner = np.concatenate([[0], np.cumsum(blank)])
    run = x
    for n in range(2, max(GRAMS) + 1):
        if len(c) < n:
            break
        run = run[:-1] * _TIMES + x[n - 1 :]
        if n in GRAMS:
            # Blanks may stand at the ends of a gram only, and not at both sides of nothing.
            middle = inner[n - 1 : n - 1 + len(run)] - inner[1 : 1 + len(run)]
            out.append(mix(run[middle == 0] + np.uint64(n)) >> np.uint64(47))
    return np.concatenate(out).astype(np.int64)


_INVERSE = np.uint64(pow(int(_TIMES), -1, 1 << 64))


def _inverse(powers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    down = np.cumprod(np.full(len(powers), _INVERSE, np.uint64))
    return down[starts]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their shares."""
    f, n = np.unique(features(text), return_counts=True)
    return f, (n / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The score of each hashed feature and the bias, learned on the sample; ``share``: label 1 among all labelled rows."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(ROWS, np.float32), math.log(p / (1 - p))
    data = [counted(t) for t in texts]
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(data)))
    steps, at = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            rate = RATE * (1 - at / steps)
            at += 1
            f, share_of = data[i]
            mean = share_of @ vectors[f] if len(f) else np.zeros(DIM, np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            slope = (p * weight[i]).astype(np.float32)
            if len(f):
                vectors[f] -= rate * share_of[:, None] * (layer @ slope)[None, :]
            layer -= 0.05 * rate * np.outer(mean, slope)
            bias -= 0.02 * rate * slope
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(labelled: DataFrame, share: float) -> tuple[np.ndarray, float]:
    """Fit in one task on a bounded sample (text, label) and bring the per-feature scores (half a megabyte) back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                if size < SAMPLE_CHARS:
                    texts.append(t or "")
                    labels.append(y)
                    size += len(t or "")
        scores, bias = fit(texts, labels, share)
        yield arrow_rows(["scores", "bias"], [pa.binary(), pa.float64()], [[scores.tobytes()], [bias]])

    row = labelled.repartition(1).sortWithinPartitions("h").mapInArrow(run, "scores binary, bias double").first()
    if row is None:  # nothing to learn from
        return fit([], [], share)
    return np.frombuffer(row["scores"], np.float32), row["bias"]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """A bounded sample (h, text, label) of the rows that may be learned from, and the share of label 1 among all of these."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    usable = stored(usable.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")))
    share = usable.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("p")).first()["p"]  # one number
    one, zero = (usable.filter(F.col("label") == k).orderBy("h", "doc_id").limit(per_class) for k in (1, 0))
    chosen = stored(one.unionByName(zero))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id").select("h", "text", "label")), share  # at most 2 * per_class rows


def remainder(doc_id, by: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def scored(docs: DataFrame, scores: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # ROWS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        for batch in batches:
            out = []
            for t in batch.column("text"):
                t = t.as_py() or ""
                total, n = 0.0, 0
                for piece in cut(t):
                    f = features(piece)
                    total += float(value[f].sum(dtype=np.float64))
                    n += len(f)
                z = bias + (total / n if n else 0.0)
                out.append(1 / (1 + math.exp(-min(max(z, -40.0), 40.0))))
            yield arrow_rows(["doc_id", "score"], [pa.int64(), pa.float64()], [batch.column("doc_id"), out])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def cut(text: str) -> Iterator[str]:
    """Pieces of about PIECE characters that end between words; together they have the features of the whole."""
    lo = 0
    while len(text) - lo > PIECE:
        hi = next((i for i in range(lo + PIECE, len(text)) if text[i] in " \t\n\v\f\r"), len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every document."""
    sample, share = labelled_sample(docs, labels, "quality", lambda d: remainder(d, 5) == 0)
    scores, bias = train(sample, share)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored(docs, scores, bias).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def query(spark, folder: str) -> DataFrame:
    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
