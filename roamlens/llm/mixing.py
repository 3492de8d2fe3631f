"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is shared again by weight. Sorted by words per weight, the sources that stop come
first, so one running sum finds the level at which the rest stop sharing.

Rounding: each document of a source is due target / source words copies. Whole copies are taken; the fraction, as a mass of
words, is rounded by pairs. A pair moves mass from one to the other until one has none or all, the way chosen at random
so that no expectation changes. The mass of the pair stays, so the words of a source stay at its target but for the last
fractional document. Pairs are folded inside leaves of at most ``LEAF`` documents, largest first; what is left of each leaf
goes to the next level of a reduction tree until one document per source is left, which is drawn by its fraction. Draws are
hashes of the ids, so reruns agree. Leaves come from a hash of the document, so a source of a third of all rows has as many
leaves as its rows need.

Null texts have no words and are taken 0 times. A null source is a source; null ids, repeated rows and ties are
separate documents. A very long text is counted whole. Extra columns are ignored. An empty table gives no rows. The sources are ordered in one task with one row each, which
holds for some millions of sources, not for one source per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import WORD, keyed, read, small_broadcast, stored

LEAF, FAN = 256, 128
SHARE = 1.5
SEED = 20240607

_ITEM = "struct<neg:bigint,_d:bigint,_t:bigint,doc_id:bigint,size:bigint,m:double,base:int>"
_OUT = "struct<doc_id:bigint,size:bigint,copies:int>"


def _item(x: str, m: str) -> str:
    return f"named_struct('neg', {x}.neg, '_d', {x}._d, '_t', {x}._t, 'doc_id', {x}.doc_id, 'size', {x}.size, 'm', {m}, 'base', {x}.base)"


def _out(x: str, extra: int) -> str:
    return f"array(named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'copies', {x}.base + {extra}))"


def _state(live: str, item: str, out: str) -> str:
    return f"named_struct('live', {live}, 'c', {item}, 'out', concat(acc.out, {out}))"


def uniform(*columns: str) -> str:
    """A draw in [0, 1) from the hash of the columns."""
    return f"(shiftrightunsigned(xxhash64({SEED}L, {', '.join(columns)}), 11) * {2.0 ** -53!r}D)"


# One step of the fold: acc.c meets x. up: words acc.c can gain from x; down: words x can gain from acc.c.
_STEP = f"""
case when not acc.live then named_struct('live', true, 'c', x, 'out', acc.out)
else element_at(transform(array(named_struct('up', least(acc.c.size - acc.c.m, x.m), 'down', least(x.size - x.m, acc.c.m))), d ->
  case when {uniform('acc.c._d', 'acc.c._t', 'x._d', 'x._t')} * (d.up + d.down) < d.down then
    case when acc.c.size - acc.c.m < x.m then {_state('true', _item('x', 'x.m - d.up'), _out('acc.c', 1))}
         when acc.c.size - acc.c.m = x.m then {_state('false', 'x', f"concat({_out('acc.c', 1)}, {_out('x', 0)})")}
         else {_state('true', _item('acc.c', 'acc.c.m + x.m'), _out('x', 0))} end
  else
    case when x.size - x.m < acc.c.m then {_state('true', _item('acc.c', 'acc.c.m - d.down'), _out('x', 1))}
         when x.size - x.m = acc.c.m then {_state('false', 'acc.c', f"concat({_out('x', 1)}, {_out('acc.c', 0)})")}
         else {_state('true', _item('x', 'x.m + acc.c.m'), _out('acc.c', 0))} end
  end), 1) end
"""
_FOLD = f"aggregate(items, named_struct('live', false, 'c', cast(null as {_ITEM}), 'out', cast(array() as array<{_OUT}>)), (acc, x) -> {_STEP})"


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, n) with rank, weight and target; one row per source, so one task can order them."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (F.col("rank") % 3 + 1).cast("int")).cast("double")
    w = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    one = Window.partitionBy()
    ordered = ranked.withColumn("weight", weight).withColumn("cap", 2.0 * F.col("source_size")).withColumns({
        "_total": SHARE * F.sum("source_size").over(one),
        "_stopped": F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_sharing": F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = (F.col("_total") - F.col("_stopped")) / F.col("_sharing")
    # The level at which the first source does not stop holds for all that follow.
    marked = ordered.withColumn("_level", F.when(F.col("cap") > level * F.col("weight"), level))
    at = F.min_by("_level", F.when(F.col("_level").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(one)
    return marked.withColumn("target", F.least("cap", F.coalesce(at * F.col("weight"), F.col("cap")))).select(
        "source", "rank", "source_size", "n", "weight", "target")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for every document."""
    sized = stored(keyed(docs, "source").select(
        "doc_id", "_d", "_t", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))))
    known = sources.count()
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.alias("s").join(small_broadcast(sources, known).alias("k"), F.col("s.source").eqNullSafe(F.col("k.source"))).select(
        "doc_id", "_d", "_t", "size", "rank", "n", F.floor(due).cast("int").alias("base"), (due - F.floor(due)).alias("f"))
    part = (F.col("f") > 0) & (F.col("size") > 0)
    done = rows.filter(~part).select("rank", "doc_id", "size", F.col("base").alias("copies"))
    left = rows.filter(part).select(
        "rank", F.pmod(F.xxhash64(F.lit(SEED), "_d", "_t"), F.ceil(F.col("n") / FAN)).alias("b"),
        F.struct((-F.col("size")).alias("neg"), "_d", "_t", "doc_id", "size", (F.col("f") * F.col("size")).alias("m"), "base").alias("item"))
    while True:
        w = Window.partitionBy("rank", "b").orderBy("item")
        leaves = left.withColumn("leaf", F.floor((F.row_number().over(w) - 1) / LEAF))
        folded = stored(leaves.groupBy("rank", "b", "leaf").agg(F.sort_array(F.collect_list("item")).alias("items")).select(
            "rank", "b", F.expr(_FOLD).alias("r")))
        done = done.unionByName(folded.select("rank", F.explode("r.out").alias("o")).select("rank", "o.*"))
        left = folded.filter("r.live").select("rank", F.floor(F.col("b") / FAN).alias("b"), F.col("r.c").alias("item"))
        if not left.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
            break
    last = F.when(F.expr(uniform("item._d", "item._t", "rank")) * F.col("item.size") < F.col("item.m"), 1).otherwise(0)
    done = done.unionByName(left.select("rank", "item.doc_id", "item.size", (F.col("item.base") + last).alias("copies")))
    return done.join(small_broadcast(sources.drop("n", "weight"), known), "rank").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"))


def query(spark, folder: str) -> DataFrame:
    return mixed(read(spark, folder, "documents")).drop("source")
