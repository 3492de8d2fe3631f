"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings (assign, access, hex) are strong and stand alone. Weak parts are reported only together: ``id`` (a user or
client name given to a key word), ``key`` (a long token of letters and digits) and ``endpoint`` (a URL or a host given to a
key word). Parts become intervals; an interval join by bins finds parts of one document at most ``SCOPE`` characters apart.
A weak key needs an identifier (id or access), a weak id needs a secret (assign, hex or key), an endpoint needs both.
A bin holds few parts, as parts of one kind don't overlap, so no bin makes many pairs. Weak parts overlapping a base
finding are dropped.

Null text is empty. Rows of one doc_id and text give the same findings each. Null ids and extra columns do no harm. An
empty table gives no rows. Positions are code points, end exclusive; ties in start go by the order of ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import keyed, read, stored

# The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ID = r"""(?<![A-Za-z0-9])((?i:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*+[0-9])(?=[0-9+/]*+[A-Za-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?<![A-Za-z0-9])((?i:host|hostname|endpoint|server))["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,}(?::[0-9]{2,5})?)"""
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
SCOPE = 200

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, pattern: str, kind: int, hint: Column, group: int = 0, least: int = 0) -> Column:
    """(start, kind, end) of the matches, from the lengths of what lies between them; ``least``: characters of the group."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else whole
    steps = F.arrays_zip(between.alias("g"), whole.alias("m"), part.alias("v"))
    none = F.array().cast(_SPANS)

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        good = F.length(x["v"]) >= least
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(hint, walked).otherwise(none)


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, _d, _t, base (strong spans) and linked (weak spans whose complements are near) for every document."""
    text = F.coalesce("text", F.lit(""))
    rows = keyed(docs).select(
        "doc_id", "_d", "_t",
        found(text, ASSIGN, 0, text.rlike(ASSIGN_HINT), 2, 6).alias("assign"),
        found(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))).alias("access"),
        found(text, HEX, 2, text.rlike(HEX)).alias("hex"),
        F.concat(found(text, ID, 3, text.rlike(ID)), found(text, KEY, 4, text.rlike(KEY)), found(text, ENDPOINT, 5, text.rlike(ENDPOINT))).alias("weak"))
    base = F.sort_array(F.concat("assign", "access", "hex"))
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = stored(rows.withColumn("base", base).withColumn("weak", clear))

    near = rows.filter(F.size("weak") > 0).select("_d", "_t", "base", "weak").dropDuplicates(["_d", "_t"])
    parts = near.select("_d", "_t", F.explode(F.concat("base", "weak")).alias("p")).select("_d", "_t", "p.*")

    def bins(df: DataFrame, wider: int) -> DataFrame:
        lo, hi = F.greatest(F.col("start") - wider, F.lit(0)), F.col("end") + wider
        return df.withColumn("bin", F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope))))

    weak = bins(parts.filter("kind >= 3"), 0).alias("a")
    other = bins(parts, scope).alias("b")
    pairs = weak.join(other, (F.col("a._d") == F.col("b._d")) & (F.col("a._t") == F.col("b._t")) & (F.col("a.bin") == F.col("b.bin"))
                      & (F.col("b.start") - F.col("a.end") <= scope) & (F.col("a.start") - F.col("b.end") <= scope))
    kind = F.col("b.kind")
    seen = pairs.groupBy("a._d", "a._t", "a.start", "a.kind", "a.end").agg(
        F.max(kind.isin(1, 3)).alias("id"), F.max(kind.isin(0, 2, 4)).alias("secret"))
    good = F.when(F.col("kind") == 3, F.col("secret")).when(F.col("kind") == 4, F.col("id")).otherwise(F.col("id") & F.col("secret"))
    linked = seen.filter(good).groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("kind").cast("int").alias("kind"), F.col("end").cast("int").alias("end")))).alias("linked"))
    return rows.drop("weak").join(linked, ["_d", "_t"], "left").withColumn("linked", F.coalesce("linked", F.array().cast(_SPANS)))


def query(spark, folder: str) -> DataFrame:
    return scan(read(spark, folder, "documents")).withColumn("every", F.sort_array(F.concat("base", "linked"))).select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("every").alias("spans"),
        F.size("linked").cast("long").alias("n_linked"))
