"""Writing tables, the warehouse build and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE = "*"  # counted rows


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned on request; the format between stages."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV for people. One file only for report-sized tables, on request."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def build_warehouse(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table once and return their row counts, read back from what was written."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")
        c = spark.read.parquet(f"{path}/{name}").agg(F.count(ONE).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    write_table(counts, f"{path}/_row_counts")
    return spark.read.parquet(f"{path}/_row_counts")


def smoke_read(views: dict[str, DataFrame]) -> DataFrame:
    """One row per view saying whether it yields a row; reads one row of each."""
    out = None
    for name, df in views.items():
        one = df.limit(1).agg((F.count(ONE) > 0).alias("has_rows")).select(F.lit(name).alias("view_name"), "has_rows")
        out = one if out is None else out.unionByName(one)
    return out


def features(gems: DataFrame, stats: DataFrame) -> DataFrame:
    """GeoJSON features, one per row, for gems and places with a point."""
    def point(df: DataFrame, layer: str, props: list[str]) -> DataFrame:
        return df.filter("lat IS NOT NULL AND lng IS NOT NULL").select(
            F.lit(layer).alias("layer"), F.col(props[0]).cast("string").alias("feature_id"),
            F.to_json(F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
                F.struct(F.lit(layer).alias("layer"), *props).alias("properties"))).alias("feature"))

    return point(gems, "gem", ["entity_id", "canonical_name", "visibility"]).unionByName(
        point(stats, "place", ["place_id", "place_name", "review_count"]))


def unmapped(gems: DataFrame) -> DataFrame:
    return gems.filter("lat IS NULL OR lng IS NULL").select("entity_id", "canonical_name")
