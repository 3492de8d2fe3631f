"""Arrival volumes, duplicate arrivals and ingestion of micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from roamlens.functions import text as T
from roamlens.functions.language import language_label
from roamlens.operators import prep


def inbox(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """A folder of submissions as a stream; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def volume(arrivals: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None, by: str = "source") -> DataFrame:
    """Arrivals per window and source. Rows later than the watermark are dropped.

    Counts combine before the shuffle, so a source with most of the arrivals is no burden.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = arrivals.withWatermark("ts", late) if arrivals.isStreaming else arrivals
    return counted.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def first_arrivals(arrivals: DataFrame, late: str = "1 day") -> DataFrame:
    """Each text once within the watermark delay, by fingerprint."""
    keyed = arrivals.withColumn("fingerprint", T.fingerprint(F.col("review_text")))
    if not arrivals.isStreaming:
        return keyed.dropDuplicates(["fingerprint"])
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def _append_once(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch under its own id, so a retried batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Everything appended so far; empty before the first batch."""
    from roamlens.sources.batches import scan_optional

    return scan_optional(spark, path, schema)


def reject_repeats(known_path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """A micro-batch writer that keeps texts never seen before, over the whole history.

    The history of fingerprints lives in the table itself, not in state, so it may grow
    without bound; a batch is joined against it by key. Batches at or above the current id are
    not part of its history, which makes a retry give the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("fingerprint", T.fingerprint(F.col("review_text"))).dropDuplicates(["fingerprint"])
        seen = read_batches(batch.sparkSession, known_path, StructType([*schema.fields, StructField("batch_id", IntegerType())])).filter(F.col("batch_id") < batch_id)
        _append_once(keyed.join(seen.select("fingerprint"), "fingerprint", "left_anti"), known_path, batch_id)

    return write


def ingest(target: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch writer: approved rows are cleaned, labelled and appended.

    A failing batch writes nothing and leaves its inputs to the next attempt.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = prep.drop_short(prep.clean(batch.filter("status = 'approved'")))
        label = language_label(F.col("review_text_clean"))
        rows = kept.withColumn("l", label).select(
            "review_id", "place_name", "review_text_clean", F.col("l.label").alias("language_label"), F.col("l.method").alias("language_method"),
            T.fingerprint(F.col("review_text_clean")).alias("fingerprint"))
        _append_once(rows, target, batch_id)

    return write


def with_end(stream: DataFrame, path: str, key: str, value: str | None = None) -> DataFrame:
    """The stream (``key``, ts and other columns) together with the end markers that arrive in a folder."""
    marks = stream.sparkSession.readStream.schema("ts timestamp").parquet(path).withColumn(key, F.lit(value).cast(dict(stream.dtypes)[key]))
    return stream.unionByName(marks, allowMissingColumns=True)


def end_of_input(spark: SparkSession, path: str, after: datetime | None, margin: timedelta = timedelta(days=2)) -> None:
    """Close a finished input: a marker later than its last event by more than any lateness, window or slot. None: there was no event."""
    spark.createDataFrame([] if after is None else [(after + margin,)], "ts timestamp").coalesce(1).write.mode("overwrite").parquet(path)


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work through what has arrived, batch by batch, and stop."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream's finished rows as parquet and stop when it is caught up."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
