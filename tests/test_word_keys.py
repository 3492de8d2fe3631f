"""Keys of mined phrases come from their words' keys; training rows are written compactly and removed."""

import glob
import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from roamlens.functions.language import loose_key, normalize_bangla, phonetic_key, strip_ending
from roamlens.operators import mining, models


def test_keys_of_phrases_equal_keys_made_of_their_words(spark):
    texts = spark.createDataFrame([(1, "আমি ঢাকা গেলাম, কক্সবাজারের শহরটা ভালো ছিলঃ"), (2, "সিলেটে ঘুরলাম উঃ ং ঢঢাকা"), (3, "no bangla"), (4, None), (5, "ড়িষা বৃষ্টির দিনে")], "review_id long, review_text string")
    got = mining.grams(mining._bodies(texts))
    rows = got.select("*", phonetic_key(F.col("phrase")).alias("k"), loose_key(F.col("phrase")).alias("l"), phonetic_key(F.col("base")).alias("m"), loose_key(F.col("base")).alias("n")).collect()
    assert len(rows) > 30 and {r.review_id for r in rows} == {1, 2, 5}
    for r in rows:
        assert (r.pk, r.pl, r.bk, r.bl) == (r.k, r.l, r.m, r.n), r
    want = texts.select(strip_ending(F.regexp_extract(normalize_bangla(F.col("review_text")), "কক্সবাজারের", 0)).alias("b")).filter("b <> ''").first().b
    assert want in {r.base for r in rows}


def test_training_rows_are_columns_and_are_removed(spark, monkeypatch):
    seen = []
    kept = models.written

    def watched(df):
        frame, remove = kept(df)
        files = [urlparse(f).path for f in frame.inputFiles()]
        seen.extend(files)
        assert files and all(os.path.exists(f) for f in files)
        return frame, remove

    monkeypatch.setattr(models, "written", watched)
    labelled = spark.createDataFrame([(f"the house of number {i}", "en") for i in range(6)] + [(f"das haus mit nummer {i}", "de") for i in range(6)], "text string, label string")
    model, classes = models.train(labelled)
    assert seen and not any(os.path.exists(f) for f in seen) and not glob.glob(os.path.dirname(seen[0]))
    assert {r.text: r.predicted for r in models.predict(model, classes, labelled).collect()} == {r.text: r.label for r in labelled.collect()}
