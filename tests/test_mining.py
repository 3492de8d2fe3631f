"""Mined spellings: texts are read for their distinct phrases first, and key pairs are compared in blocks."""

from roamlens.functions.tasks import indel
from roamlens.operators import joins, mining


def test_pairs_that_reach_a_ratio_equal_brute_force(spark):
    left, right = ["sndrbn", "kks bzr", "dk"], [f"{a}{b}n" for a in ("sndr", "kks ", "d") for b in ("b", "bz", "k", "")] + ["x" * 70]
    frames = [spark.createDataFrame([(x,) for x in side], "id string") for side in (left, right)]
    want = {(a, b, indel(a, b)) for a in left for b in right if indel(a, b) >= 75}
    assert want and {tuple(r) for r in joins.reaching(*frames, 75, block=4).collect()} == want


def test_aligned_spelling_is_found_and_written_once(spark):
    pairs = spark.createDataFrame([("1", "আমি ঢাকা গেলাম", "i went to dhaka"), ("2", "ঢাকা ভালো", "nothing named"), ("3", "সিলেট শহর", "sylhet town")],
                                  "review_id string, original string, translation string")
    got = mining.mine_aligned(pairs, spark.createDataFrame([("dhaka",), ("sylhet",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {("ঢাকা", "dhaka"), ("সিলেট", "sylhet")}
    # What reads it (three times in count_phrases) does not mine it again.
    assert "Scan ExistingRDD" in got._jdf.queryExecution().executedPlan().toString() and "Python" not in got._jdf.queryExecution().executedPlan().toString()
