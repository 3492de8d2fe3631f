"""Reading review exports and giving them the canonical schema."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.session import broadcast_if_small

RAW_COLUMNS = vocab.REQUIRED_COLUMNS + vocab.OPTIONAL_COLUMNS + vocab.PROVENANCE_COLUMNS
RAW_SCHEMA = T_.StructType([T_.StructField(c, T_.StringType()) for c in RAW_COLUMNS])


def scan_batches(spark: SparkSession, pattern: str, schema: T_.StructType | None = None) -> DataFrame:
    """Every matching CSV batch, with the row's file and position for first-wins rules.

    Files may carry any subset of the optional columns. They are read in groups of equal
    header, so a column is always taken by name; a header without a required column fails.
    """
    first_block = spark.read.text(pattern).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value",
        F.monotonically_increasing_id().alias("line")).filter("start = 0")
    heads = first_block.groupBy("file").agg(F.min_by("value", "line").alias("header")).groupBy("header").agg(
        F.sort_array(F.collect_list("file")).alias("files"))
    groups = {tuple(next(csv.reader([r.header]))): r.files for r in heads.toLocalIterator()}  # names, no data
    if not groups:
        return empty(spark, schema or RAW_SCHEMA).withColumn("row_order", F.lit(None).cast("string"))
    frames = []
    for header, members in groups.items():
        missing = [c for c in vocab.REQUIRED_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"{members[0]} lacks required column(s): {', '.join(missing)}")
        fields = T_.StructType([T_.StructField(c, T_.StringType()) for c in header])
        raw = spark.read.schema(fields).option("header", True).option("multiLine", True).option("escape", '"').csv(members)
        frames.append(raw.withColumn("file", F.input_file_name()).withColumn(
            "row_order", F.concat_ws("#", "file", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def empty(spark: SparkSession, schema: T_.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def scan_optional(spark: SparkSession, path: str, schema: T_.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The table, or an empty one with the schema when the input does not exist."""
    try:
        return conform(spark.read.options(**options).format(fmt).load(path), schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return empty(spark, schema)


def conform(df: DataFrame, schema: T_.StructType) -> DataFrame:
    """Exactly these columns: missing ones NULL, others dropped, types cast."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def rename_columns(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Export names to canonical ones; never over an existing column; unknown ones dropped."""
    wanted = {**vocab.EXPORT_ALIASES, **(extra or {})}
    taken = set(df.columns)
    renames: dict[str, str] = {}
    for name in df.columns:
        target = wanted.get(name)
        if target and target not in taken:
            renames[name] = target
            taken.add(target)
    out = df.withColumnsRenamed(renames)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c in RAW_COLUMNS])


def resolve_text(df: DataFrame) -> DataFrame:
    """Analysis text and original text from the three export layouts."""
    first = lambda names: next((n for n in names if n in df.columns), None)
    orig, trans, plain = (first(n) for n in (
        vocab.ORIGINAL_TEXT_FIELDS, vocab.TRANSLATED_TEXT_FIELDS, vocab.PLAIN_TEXT_FIELDS))
    lang = first(vocab.ORIGINAL_LANGUAGE_FIELDS)
    value = lambda c: T_blank(F.col(f"`{c}`")) if c else F.lit(None).cast("string")
    p, t, o = value(plain), value(trans), value(orig)
    if orig:
        original = F.coalesce(o, p) if not trans else F.coalesce(o, F.when(t.isNull(), p))
        text = F.coalesce(t, p, original)
    elif trans:
        original, text = p, F.coalesce(t, p)
    else:
        original, text = None, p
    used = {c for c in (orig, trans, plain) if c}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in used], text.alias("review_text"), *(
        [original.alias("review_text_original")] if original is not None else []))
    if lang:
        out = out.withColumn("original_language", T_blank(F.col(f"`{lang}`")))
        if lang != "original_language":
            out = out.drop(lang) if "review_language" in out.columns else out.withColumnRenamed(lang, "review_language")
    return out


def T_blank(c: Column) -> Column:
    """NULL for blank text."""
    return F.when(T.strip(c) != "", c)


def source_type(source: Column) -> Column:
    bare = F.lower(T.strip(F.coalesce(source, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in vocab.SOURCE_TO_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, bare), bare)


def with_provenance(df: DataFrame) -> DataFrame:
    """The six provenance columns, derived or defaulted, never guessed."""
    have = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    number = lambda c: F.expr(f"try_cast({c} AS double)") if c in df.columns else F.lit(None).cast("double")
    others = [c for c in df.columns if c not in vocab.PROVENANCE_COLUMNS]
    return df.select(
        *others, F.coalesce(T_blank(have("source_type", "string")), source_type(have("source", "string"))).alias("source_type"),
        have("collected_at", "string").alias("collected_at"), have("anchor_place", "string").alias("anchor_place"),
        F.coalesce(number("discovery_round").cast("int"), F.lit(0)).alias("discovery_round"),
        number("lat").alias("lat"), number("lng").alias("lng"))


def stamp_provenance(df: DataFrame, collected_at: str, source_type_flag: str | None = None,
                     anchor_place: str | None = None, discovery_round: int | None = None,
                     collected_flag: str | None = None) -> DataFrame:
    """A given flag beats the export; the export beats the default."""
    if discovery_round is not None and discovery_round < 0:
        raise ValueError("a discovery round cannot be negative")
    out = df
    if source_type_flag:
        out = out.withColumn("source_type", F.lit(source_type_flag))
    elif "source_type" not in out.columns:
        out = out.withColumn("source_type", source_type(F.col("source")))
    if anchor_place is not None:
        out = out.withColumn("anchor_place", F.lit(anchor_place))
    if discovery_round is not None:
        out = out.withColumn("discovery_round", F.lit(discovery_round))
    elif "discovery_round" not in out.columns:
        out = out.withColumn("discovery_round", F.lit(0))
    if collected_flag:
        out = out.withColumn("collected_at", F.lit(collected_flag))
    elif "collected_at" not in out.columns:
        out = out.withColumn("collected_at", F.lit(collected_at))
    return out


def rescale_ratings(df: DataFrame, scale: float) -> DataFrame:
    """Ratings and place averages brought to five points, with a flag when some exceed it."""
    out = df.withColumn("review_rating", T.rescale_rating(F.col("review_rating"), scale)).withColumn(
        "place_avg_rating", T.rescale_rating(F.col("place_avg_rating"), scale))
    return out.withColumn("exceeds_scale", F.col("review_rating") > 5)


def referential_filter(topic_map: DataFrame, topics: DataFrame, preferences: DataFrame) -> DataFrame:
    """Map rows of known topics; an unknown preference becomes NULL."""
    known = preferences.select(F.col("preference_id").alias("known_id")).distinct()
    return (
        topic_map.join(broadcast_if_small(topics.select("topic_id").distinct()), "topic_id", "left_semi")
        .join(broadcast_if_small(known), F.col("preference_id") == F.col("known_id"), "left")
        .withColumn("preference_id", F.col("known_id")).drop("known_id"))


def drop_orphans(child: DataFrame, reviews: DataFrame) -> DataFrame:
    return child.join(reviews.select("review_id"), "review_id", "left_semi")
