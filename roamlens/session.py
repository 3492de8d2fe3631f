"""Session settings and the helpers that keep plans safe at scale."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only when its rows, weighed or bounded, are at or below this.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Files are compressed, so beyond this many of their bytes their rows are counted; decoded rows may be a little larger than written ones.
COUNTED_FROM, DECODED_LIMIT = 1024 * 1024, 96 * 1024 * 1024


def get_session(app: str = "roamlens", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates, AQE and skew handling on.

    Master, memory and partition counts are the cluster's; with ``cpus`` the session is a local one that
    gets them here, with small file splits so that a table in one file still occupies all cores.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", os.environ.get("ROAMLENS_SHUFFLE", "8"))
            .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; an upper bound for filters and aggregates, but of compressed bytes where files are read."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def decoded_bytes(df: DataFrame) -> int:
    """An upper bound of a plan's rows in memory: the rows its files hold (from their footers, no column is read) at Catalyst's row width.

    Catalyst's estimate starts from the compressed size of the files, which may be a tenth of what the driver holds to broadcast them. 0: no such files.
    """
    formats = set(re.findall(r"\bRelation ?\[.*?\] (parquet|orc)\b", df._jdf.queryExecution().optimizedPlan().toString()))
    files = df.inputFiles() if len(formats) == 1 else []
    width = 8 + df._jdf.schema().defaultSize()
    return df.sparkSession.read.format(*formats).load(files).count() * width if files else 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast when the size is proven small, by Catalyst's estimate and, for files, by their rows.

    The bound holds only where no operator can add rows: a plan with an explode, an expand, a join or
    Python rows gets no hint. Then, and beyond the limit, the join stays a shuffle join that AQE may still turn
    into a broadcast from measured sizes, or split where a key is hot.
    """
    grows = re.search(r"\b(Generate|Expand|Join|MapIn\w+|FlatMapGroups\w+)\b", df._jdf.queryExecution().optimizedPlan().toString())
    size = plan_bytes(df)
    if grows or size > limit or (size > COUNTED_FROM and decoded_bytes(df) > DECODED_LIMIT):
        return df
    return F.broadcast(df)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="roamlens-ck-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and continue from there.

    A lost executor then re-reads files instead of replaying every earlier round.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The frame written beside the checkpoints as compressed columns and read back, and what removes it; for rows much larger in memory than in columns."""
    _ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    path = f"{sc.getCheckpointDir().rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), lambda: place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_measured(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Write the frame, weigh its rows, and hint a broadcast when they are small; for plans that Catalyst cannot bound."""
    kept = cut_lineage(df)
    width = lambda f: F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(0)
    row = sum((width(f) + 16 for f in kept.schema.fields), F.lit(32))
    weight = kept.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]  # one number
    return F.broadcast(kept) if weight <= limit else kept


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1..n over a total order without moving all rows into one task.

    Rows are range partitioned on the order and written out, so the slice id is fixed;
    only one row per slice is then summed to give each slice its offset.
    """
    sliced = cut_lineage(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy("_slice").orderBy(*order)
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_off") + F.row_number().over(inside))
        .drop("_slice", "_off")
    )


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``, combined before the shuffle.

    ``min_by`` keeps one row per key and map task, so a key holding a third of all rows
    costs no more than any other; a ranking window would sort it in one task.
    """
    names = df.columns
    picked = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct(*[F.col(c) for c in names]), order).alias("_row")
    )
    return picked.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    Spark applies the group limit before the shuffle, so at most ``k`` rows per key leave
    each map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
