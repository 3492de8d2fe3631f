"""Topic clusters and text classifiers on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions.similarity import unit
from roamlens.operators.stats import binary_scores
from roamlens.session import broadcast_if_small, cut_lineage, written

ONE = "*"  # counted rows
MIN_SHARE, MIN_SIZE = 0.004, 6  # fixed values


def topic_count(n_docs: int, min_size: int, max_topics: int) -> int:
    """Clusters to ask for: as many as can reach the minimum size, at most ``max_topics``; one rule for every size."""
    return max(2, min(max_topics, n_docs // min_size))


def topic_clusters(vectors: DataFrame, group: str, seed: int = 42, max_topics: int = 40) -> DataFrame:
    """Topics per language group by k-means on unit vectors; small clusters become -1.

    Language groups are few and are fitted one after another; each fit is distributed over
    all its rows. Topic ids of later groups start after those of earlier ones.
    """
    sizes = {r[group]: r["n"] for r in vectors.groupBy(group).agg(F.count(ONE).alias("n")).orderBy(group).toLocalIterator()}
    base = vectors.withColumn("features", array_to_vector(unit(F.col("embedding"))))
    out, offset = None, 0
    for name, n in sizes.items():
        floor = max(MIN_SIZE, round(n * MIN_SHARE))
        k = topic_count(n, floor, max_topics)
        part = base.filter(F.col(group) == name)
        model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="c").fit(part)
        labelled = model.transform(part).select("vec_id", group, "c")
        big = labelled.groupBy("c").agg(F.count(ONE).alias("n")).filter(F.col("n") >= floor).select("c", F.lit(1).alias("big"))
        got = labelled.join(broadcast_if_small(big), "c", "left").select(
            "vec_id", group, F.when(F.col("big") == 1, F.col("c") + offset).otherwise(-1).alias("topic_id"))
        out = got if out is None else out.unionByName(got)
        offset += k
    return out


# ---- character n-gram classifiers -----------------------------------------------------------------
def char_grams(text, low: int = 1, high: int = 4):
    """Character n-grams inside words, each word padded with a space at both ends.

    Padded words lie side by side, so what holds two spaces in a row is no part of one word. The pattern goes on by one character a time.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    body = F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")

    def of(n: int):
        apart = f"(?!.{{0,{n - 2}}}  )" if n > 1 else ""
        return F.array_remove(F.regexp_extract_all(body, F.lit(f"(?s)(?:(?=({apart}.{{{n}}})))?."), F.lit(1)), "")

    return F.concat(*[of(n) for n in range(low, high + 1)])


def majority_labels(votes: DataFrame) -> DataFrame:
    """The label most annotators gave a text; ties are dropped."""
    n = votes.groupBy("text", "label").agg(F.count(ONE).alias("n"))
    g = n.groupBy("text").agg(F.max("n").alias("top"), F.max_by("label", "n").alias("label"))
    tied = n.join(g.select("text", "top"), "text").filter("n = top").groupBy("text").agg(F.count(ONE).alias("k")).filter("k = 1")
    return g.join(tied.select("text"), "text", "left_semi").select("text", "label")


def check_labels(labelled: DataFrame) -> dict[str, int]:
    """Examples per class; refuses data no model can be judged on."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(ONE).alias("n")).toLocalIterator()}  # one row per class
    if len(counts) < 2:
        raise ValueError(f"a classifier needs two classes, found {sorted(counts)}")
    few = {k: n for k, n in counts.items() if n < 2}
    if few:
        raise ValueError(f"classes with fewer than two examples: {few}")
    return counts


def with_folds(labelled: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """Balanced folds per class: rows in hash order inside 256 buckets of a class, numbered on across the buckets.

    Every class with at least ``folds`` rows is in every fold. Only one count per bucket is summed over a class, so no
    class is sorted in one task.
    """
    spot = labelled.withColumn("_h", F.xxhash64(F.lit(seed), "label", "text")).withColumn("_b", F.pmod("_h", F.lit(256)))
    before = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spot.groupBy("label", "_b").agg(F.count(ONE).alias("_n")).select("label", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("label", "_b").orderBy("_h", "text")
    return spot.join(offsets, ["label", "_b"]).withColumn("fold", F.pmod(F.col("_off") + F.row_number().over(inside) - 1, F.lit(folds)).cast("int")).drop("_h", "_b", "_off")


def _hashing(dims: int) -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="tf", numFeatures=dims)


def _stages():
    return Pipeline(stages=[
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=30, regParam=0.01)])


def _prepared(labelled: DataFrame, counts: dict[str, int]) -> DataFrame:
    total, k = sum(counts.values()), len(counts)
    weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, total / (k * n))])
    number = F.create_map(*[F.lit(x) for i, c in enumerate(sorted(counts)) for x in (c, float(i))])
    return labelled.withColumn("grams", char_grams(F.col("text"))).withColumn("weight", weight[F.col("label")]).withColumn("y", number[F.col("label")])


def train(labelled: DataFrame, dims: int = 1 << 14):
    """A fitted classifier of (text, label) and its classes in order.

    Texts are cut and hashed once; fitting reads what was written, as compressed columns: a text has many more pieces than letters. They are removed afterwards.
    """
    counts = check_labels(labelled)
    hashed, remove = written(_hashing(dims).transform(_prepared(labelled, counts)).select("tf", "weight", "y"))
    try:
        stages = _stages().fit(hashed).stages
    finally:
        remove()
    return PipelineModel([_hashing(dims), *stages]), sorted(counts)


def predict(model, classes: list[str], texts: DataFrame) -> DataFrame:
    """Label and confidence of every text of a table."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(texts.withColumn("grams", char_grams(F.col("text"))))
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(*texts.columns, names[F.col("prediction").cast("int")].alias("predicted"),
                         F.array_max(vector_to_array("probability")).alias("confidence"))


def cross_validate(labelled: DataFrame, folds: int = 5, dims: int = 1 << 14) -> DataFrame:
    """Out-of-fold precision, recall and F1 per class, with the macro F1."""
    counts = check_labels(labelled)
    folds = max(2, min(folds, min(counts.values())))
    hashed = _hashing(dims).transform(_prepared(labelled, counts)).select("text", "label", "tf", "weight", "y")
    data = cut_lineage(with_folds(hashed, folds).select("tf", "weight", "y", "fold"))
    out = None
    for f in range(folds):
        model = _stages().fit(data.filter(F.col("fold") != f))
        got = model.transform(data.filter(F.col("fold") == f)).select("y", "prediction")
        out = got if out is None else out.unionByName(got)
    classes = sorted(counts)
    pairs = cut_lineage(out).select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("label"), (F.col("prediction") == float(i)).cast("int").alias("predicted"), (F.col("y") == float(i)).cast("int").alias("truth"))
        for i, c in enumerate(classes)])).alias("x")).select("x.*")
    scores = binary_scores(pairs, ["label"])
    macro = scores.agg(F.avg(F.coalesce("f1", F.lit(0.0)))).scalar()
    return scores.withColumn("macro_f1", F.round(macro, 6))
