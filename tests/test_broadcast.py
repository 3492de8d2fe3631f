"""A side is broadcast for what its rows take in memory, not for the compressed bytes of its files."""

from pyspark.sql import functions as F

from roamlens.session import BROADCAST_LIMIT, broadcast_if_small, plan_bytes


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_files_that_compress_well_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1_700_000).select("id", *[F.lit("the same words").alias(c) for c in "abc"]).write.parquet(path)
    big = spark.read.parquet(path)
    assert plan_bytes(big) < BROADCAST_LIMIT  # of 130 MB and more in memory
    assert not hinted(broadcast_if_small(big))
    assert not hinted(broadcast_if_small(big.filter("id >= 0").groupBy("id").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("c").alias("c"))))
    assert hinted(broadcast_if_small(big.select("id").filter("id < 5"))) and hinted(broadcast_if_small(spark.range(3)))
