"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

1. Voters. Words and word stems (4 to 6 letters) that are far more frequent in toxic than in other labelled rows make up a
   lexicon; its words are dealt by hash over ``GROUPS`` voters, so each voter knows some of every language. A fixed list of insults and three patterns (shouting, runs of marks, an insulted
   second person) vote besides. A voter fires or is silent on each document.
2. Label model. Over all documents one grouped pass gives how often voters fire alone and in pairs. Without labels, the
   covariances of three voters give each one's separation of the classes (the median over all triplets), hence its firing rates
   in both classes. Covariance that this does not explain is correlation; a voter's evidence is divided by one plus its sum.
   The class share comes from the labelled rows that may be used.
3. Classifier. A logistic regression on words and stems learns the posteriors of a bounded sample (``PER_CLASS`` documents on
   each side of one half, in hash order, weighted back to their shares); its ``TERMS`` terms are those most associated with the posteriors.

Whole texts are read. Null and empty texts have no term and score the bias. Null labels are not learned from; without labelled
rows of both classes the mined voters are missing and the fixed ones remain. Repeated rows and ties score alike. Null ids are
fine. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import arrow_rows, keyed, read, stored
from roamlens.llm.subwords import labelled_sample, remainder

PER_CLASS, SAMPLE_CHARS, GROUPS, LEXICON, TERMS, STEPS, SURE = 3000, 24_000_000, 12, 600, 1500, 200, 11.0
STEMS = (4, 5, 6)

# A general list of insults.
INSULTS = {"idiot", "idiots", "moron", "morons", "loser", "losers", "stupid", "dumb", "pathetic", "worthless", "scum", "trash", "garbage", "clown",
           "disgusting", "imbecile", "fool", "jerk", "filth", "vermin", "dummkopf", "trottel", "abschaum", "versager", "imbécile", "crétin", "ordure",
           "abruti", "estúpido", "imbécil", "basura", "escoria", "inútil"}

_WORD = re.compile(r"[^\W\d_]+")
_YOU = re.compile(r"\b(?:you|du|tu|usted)\b(?:\W+\w+){0,3}\W+(?:" + "|".join(sorted(INSULTS)) + r")\b")
_MARKS = re.compile(r"[!?]{3,}")


def terms(text: str) -> set[str]:
    """Distinct words and stems; a stem ends with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def mine(batches: Iterator[tuple[str, int]]) -> list[str]:
    """The ``LEXICON`` surest terms of label 1: 8 times the share of label 0, beyond what chance gives.

    Surety is the log likelihood ratio of the term's label-1 rows against the sample's share of label 1; ``SURE`` keeps
    chance findings among some hundred thousand terms rare.
    """
    seen, many = (Counter(), Counter()), [0, 0]
    for text, y in batches:
        seen[y].update(terms(text))
        many[y] += 1
    if not min(many):
        return []
    share, sure = many[1] / sum(many), {}
    for t, one in seen[1].items():
        zero = seen[0][t]
        q = one / (one + zero)
        if (one + 0.5) / (many[1] + 1) > 8 * (zero + 0.5) / (many[0] + 1) and q > share:
            g = one * math.log(q / share) + (zero * math.log((1 - q) / (1 - share)) if zero else 0)
            if g > SURE:
                sure[t] = g
    return sorted(sure, key=lambda t: (-sure[t], t))[:LEXICON]


def votes(text: str, lexicon: set[str]) -> list[int]:
    """The numbers of the voters that fire: a word in the lexicon, or with a stem there, fires the voter of its hash."""
    words = set(_WORD.findall(text.lower()))
    out = {crc32(w.encode()) % GROUPS for w in words if w in lexicon or any(w[:k] + "*" in lexicon for k in STEMS if len(w) > k)}
    if not INSULTS.isdisjoint(words):
        out.add(GROUPS)
        if _YOU.search(text.lower()):
            out.add(GROUPS + 3)
    letters = sum(map(str.isalpha, text)) if text.isupper() else 0
    if letters > 20:
        out.add(GROUPS + 1)
    if _MARKS.search(text):
        out.add(GROUPS + 2)
    return sorted(out)


VOTERS = GROUPS + 4


def label_model(n: int, pairs: dict[tuple[int, int], int], share: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, evidence of firing, evidence of silence) from how often voters fire alone (i, i) and together (i, j)."""
    bias = math.log(share / (1 - share))
    fire, silent = np.zeros(VOTERS), np.zeros(VOTERS)
    if not n:
        return bias, fire, silent
    both = np.zeros((VOTERS, VOTERS))
    for (i, j), k in pairs.items():
        both[i, j] = both[j, i] = k / n
    rate = np.diag(both).copy()
    cov = both - np.outer(rate, rate)
    used = [i for i in range(VOTERS) if 0 < rate[i] < 1]
    spread = share * (1 - share)
    gap = np.zeros(VOTERS)
    for i in used:
        each = [cov[i, j] * cov[i, k] / cov[j, k] for j in used for k in used if j < k and i not in (j, k) and min(cov[i, j], cov[i, k], cov[j, k]) > 1e-9]
        if each:
            gap[i] = math.sqrt(max(0.0, float(np.median(each))) / spread)
    # Rates stay inside (0, 1), whatever the noise of the triplets.
    top = np.minimum((1 - rate) / (1 - share), rate / share)
    gap = np.minimum(gap, 0.98 * top)
    deviation = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    left = np.abs(cov - spread * np.outer(gap, gap)) / np.outer(deviation, deviation)
    np.fill_diagonal(left, 0)
    for i in used:
        if gap[i] <= 0:
            continue
        one = min(max(rate[i] + (1 - share) * gap[i], 1e-4), 1 - 1e-4)
        zero = min(max(rate[i] - share * gap[i], 1e-5), 1 - 1e-4)
        weight = 1 / (1 + left[i, used].sum())
        fire[i], silent[i] = weight * math.log(one / zero), weight * math.log((1 - one) / (1 - zero))
    return bias, fire, silent


def posterior(v: list[int], model: tuple[float, np.ndarray, np.ndarray]) -> float:
    bias, fire, silent = model
    z = bias + silent.sum() + sum(fire[i] - silent[i] for i in v)
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def regress(texts: list[str], p: np.ndarray, weight: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights of the most associated terms and the bias, by accelerated gradient steps on the soft labels."""
    sets = [terms(t) for t in texts]
    n = Counter(t for s in sets for t in s)
    hit: Counter = Counter()
    mean = float(np.average(p))
    for s, q in zip(sets, p - mean):
        for t in s:
            hit[t] += q
    z = {t: abs(v) / math.sqrt(n[t] * max(mean * (1 - mean), 1e-6)) for t, v in hit.items() if n[t] >= 5}
    chosen = sorted((t for t, v in z.items() if v > 4), key=lambda t: (-z[t], t))[:TERMS]
    number = {t: i for i, t in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen) + 1), np.float32)
    for i, s in enumerate(sets):
        for t in s & number.keys():
            x[i, number[t]] = 1
    x[:, -1] = 1
    weight = (weight / weight.sum()).astype(np.float32)
    ridge = np.full(x.shape[1], 1e-4, np.float32)
    ridge[-1] = 0
    step = 1 / (0.25 * float((weight * (x.sum(axis=1) ** 1.0 * 2)).sum()) + 1e-4)
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = math.log(max(float(weight @ p), 1e-6) / max(1 - float(weight @ p), 1e-6))
    ahead = w.copy()
    for k in range(STEPS):
        q = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (weight * (q - p)) + ridge * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return {t: float(v) for t, v in zip(chosen, w)}, float(w[-1])


def _one_task(df: DataFrame, run, schema: str):
    return df.repartition(1).sortWithinPartitions("h").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every document."""
    sample, share = labelled_sample(docs, labels, "toxic", lambda d: remainder(d, 4) == 2, per_class)
    share = min(max(share, 0.005), 0.5)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t or "", y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()))
        yield arrow_rows(["term"], [pa.string()], [mine(rows)])

    lexicon = {r["term"] for r in _one_task(sample, find, "term string").collect()}  # at most LEXICON
    rows = keyed(docs).withColumn("h", F.xxhash64(F.lit(11), "_d", "_t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield arrow_rows(["_d", "_t", "h", "v"], [pa.int64()] * 3 + [pa.list_(pa.int32())], [
                b.column("_d"), b.column("_t"), b.column("h"), [votes(t.as_py() or "", lexicon) for t in b.column("text")]])

    voted = stored(rows.select("_d", "_t", "h", "text").mapInArrow(vote, "_d long, _t long, h long, v array<int>"))
    n = voted.count()
    couple = voted.filter(F.size("v") > 0).select(F.explode("v").alias("i"), "v").select("i", F.explode("v").alias("j")).filter("i <= j")
    pairs = {(r["i"], r["j"]): r["k"] for r in couple.groupBy("i", "j").agg(F.count(F.lit(1)).alias("k")).collect()}  # voters squared
    model = label_model(n, pairs, share)

    bias, fire, silent = model
    evidence = F.array(*[F.lit(float(f - s)) for f, s in zip(fire, silent)])
    z = F.aggregate("v", F.lit(float(bias + silent.sum())), lambda a, i: a + F.element_at(evidence, i + 1))
    judged = voted.select("_d", "_t", "h", (1 / (1 + F.exp(-z))).alias("p"))
    sides = {r["one"]: r["n"] for r in judged.groupBy((F.col("p") >= 0.5).alias("one")).agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = [judged.filter(F.col("p") >= 0.5 if one else F.col("p") < 0.5).orderBy("h", "_d", "_t").limit(per_class).withColumn(
        "weight", F.lit(sides.get(one, 0) / max(1, min(per_class, sides.get(one, 0))))) for one in (True, False)]
    chosen = stored(halves[0].unionByName(halves[1]))
    taught = stored(rows.select("_d", "_t", "text").join(F.broadcast(chosen), ["_d", "_t"]).select("h", "text", "p", "weight"))  # at most 2 * per_class rows

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, p, weight, size = [], [], [], 0
        for b in batches:
            for t, q, w in zip(b.column("text").to_pylist(), b.column("p").to_pylist(), b.column("weight").to_pylist()):
                if size < SAMPLE_CHARS:
                    texts.append(t or "")
                    p.append(q)
                    weight.append(w)
                    size += len(t or "")
        w, b0 = regress(texts, np.array(p, np.float32), np.array(weight)) if texts else ({}, bias)
        yield arrow_rows(["term", "w"], [pa.string(), pa.float64()], [[*w, None], [*w.values(), b0]])

    weights = {r["term"]: r["w"] for r in _one_task(taught, learn, "term string, w double").collect()}  # at most TERMS + 1
    start = weights.pop(None, bias)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                z = start + math.fsum(weights[x] for x in terms(t.as_py() or "") & weights.keys())
                out.append(1 / (1 + math.exp(-min(max(z, -40.0), 40.0))))
            yield arrow_rows(["doc_id", "score"], [pa.int64(), pa.float64()], [b.column("doc_id"), out])

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return rows.select("doc_id", "text").mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def query(spark, folder: str) -> DataFrame:
    return classify(read(spark, folder, "documents"), read(spark, folder, "labels"))
