"""Joins of names by likeness: exact candidate indexes for string ratios, suggestions and links.

The indel ratio of names with n and m characters is 2 L / (n + m), L their longest common subsequence, so it is at most the share of
letters they have in common. Both sides order their letters (repeats numbered) from rare to common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.operators.joins import closest, sparse_candidates
from roamlens.operators.links import components
from roamlens.operators.retrieval import containment_pairs
from roamlens.session import broadcast_if_small, cut_lineage, top_per_key

ONE = "*"  # counted rows
SURE = 0.75  # from here the letter pair index is exact and cheap


def _fits(n: Column, m: Column, ratio: Column) -> Column:
    return 2 * F.least(n, m) >= ratio * (n + m) - 1e-9


def _needed(n: Column, m: Column, ratio: Column) -> Column:
    """Letters in common that names of these lengths need."""
    return F.ceil(ratio / 2 * (n + m) - 1e-9)


def _letters(names: DataFrame, keep: list[str]) -> DataFrame:
    """One row per letter of a name; the second, third ... of a kind has a number."""
    chars = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", i, F.lit(1)))
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return names.filter(F.length("key") > 0).select(*keep, F.length("key").alias("n"), F.explode(numbered).alias("g"))


def letter_candidates(left: DataFrame, right: DataFrame, ratio: Column, by: list[str] | None = None, apart: str | None = None) -> DataFrame:
    """(by, lid, rid) of all pairs whose letters allow an indel ratio of ``ratio``; none that reaches it is missed.

    Such a pair has T = ceil(ratio (n + m) / 2) letters in common. If T is two or more, the first size - T + 2 letters of both, rare ones
    first, have two in common, so a name is filed under the pairs of these letters; T is taken for the shortest partner a name may have. Names of up
    to two letters together with one have T = 1 and are filed under single letters. What meets is checked by lengths and by the
    letters in common. Both sides hold ``by``, id, key and what ``ratio`` (0.6 or more, equal for both) is made of. A name may
    have several keys. With ``apart`` only pairs that differ in that column meet, and only letters held by several of its values.
    """
    by, extra = by or [], [apart] if apart else []
    keep = [*by, "id", *extra, "ratio"]
    sides = [cut_lineage(_letters(side.withColumn("ratio", ratio), keep)) for side in (left, right)]
    freq = sides[1].groupBy("g").agg(F.count(ONE).alias("df"))

    def filed(letters: DataFrame, name: str) -> DataFrame:
        known = letters.join(broadcast_if_small(freq), "g")
        o = known.groupBy(*keep, "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s")).withColumn("g", F.transform("s", lambda x: x["g"]))
        n, r = F.col("n"), F.col("ratio")
        two = F.greatest(_needed(n, F.ceil(n * r / (2 - r) - 1e-9), r), F.lit(2))
        first = F.slice("g", 1, F.greatest(F.size("g") - two + 2, F.lit(0)).cast("int"))
        pairs = F.flatten(F.transform(first, lambda x, i: F.transform(
            F.filter(first, lambda y, j: j > i), lambda y: F.concat(x, F.lit("\u0001"), y))))
        keys = F.concat(pairs, F.when(n <= 2, F.col("g")).otherwise(F.array().cast("array<string>")))
        return o.select(*by, *[F.col(c).alias(f"{name}{c}") for c in ("id", "n", "g", "ratio", *extra)], F.explode(keys).alias("_key"))

    l, r = filed(sides[0], "l"), filed(sides[1], "r")
    check = _fits(F.col("ln"), F.col("rn"), F.col("lratio")) & (
        F.size(F.array_intersect("lg", "rg")) >= _needed(F.col("ln"), F.col("rn"), F.col("lratio")))
    if apart:
        l = _split_keys(l, [*by, "_key"], f"l{apart}")
        check = (F.col(f"l{apart}") != F.col(f"r{apart}")) & check
    return l.join(r, [*by, "_key"]).filter(check).select(*by, "lid", "rid").distinct()


def _split_keys(filed: DataFrame, key: list[str], column: str) -> DataFrame:
    """The rows whose key is held by several values of the column."""
    mixed = filed.groupBy(*key).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo <> hi").select(*key)
    return filed.join(mixed, key, "left_semi")


def cover_candidates(names: DataFrame, ratio: Column, by: list[str], apart: str) -> DataFrame:
    """(by, lid, rid) of pairs whose shared words alone can be most of the left name (``ratio`` between them and the name).

    They are ratio / (2 - ratio) of its length, so one of them is among the left name's rarest words, as many as leave less than that.
    The right name is filed under all its words.
    """
    words = F.array_distinct(F.filter(F.split("key", " "), lambda w: w != ""))
    w = cut_lineage(names.withColumn("ratio", ratio).select(*by, "id", apart, "ratio", F.explode(words).alias("_w")))
    df = w.groupBy(*by, "_w").agg(F.count(ONE).alias("df"))
    ranked = w.join(df, [*by, "_w"]).groupBy(*by, "id", apart, "ratio").agg(F.array_sort(F.collect_list(F.struct("df", "_w"))).alias("s"))
    size = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["_w"]) + 1) - 1
    behind = lambda i: F.aggregate(F.slice("s", i + 1, F.size("s")), F.lit(0), lambda a, x: a + F.length(x["_w"]) + 1) - 1
    first = F.filter(F.transform("s", lambda x, i: F.struct(x["_w"].alias("w"), behind(i).alias("left"))),
                     lambda x: x["left"] >= F.col("ratio") / (2 - F.col("ratio")) * size - 1e-9)
    l = ranked.select(*by, F.col("id").alias("lid"), F.col(apart).alias("la"), F.explode(first).alias("x")).select(*by, "lid", "la", F.col("x.w").alias("_w"))
    r = _split_keys(w.select(*by, "_w", F.col("id").alias("rid"), F.col(apart).alias("ra")), [*by, "_w"], "ra")
    return l.join(r, [*by, "_w"]).filter("la <> ra").select(*by, "lid", "rid").distinct()


def alike_groups(names: DataFrame, by: list[str], paired: int = 64, rounds: int = 2) -> DataFrame:
    """(by, name, hub): names with a fuzzy ratio of ``need`` or more inside ``by``, tied to common hubs.

    Groups of up to ``paired`` names are paired. In a larger one all names are compared with eight of them, drawn by hash from
    those like none before, ``rounds`` times, so a dense group falls together at a few comparisons per name. Only names that are then still in
    different components are looked up, by letters and by shared words, and compared; one link per pair of components goes on. The
    components are those of all pairs in either case. ``names`` holds ``by``, name and need (0 to 100), one row per name.
    """
    sizes = names.groupBy(*by).agg(F.count(ONE).alias("_n")).filter("_n > 1")
    held = cut_lineage(names.join(sizes, by))
    few = held.filter(F.col("_n") <= paired)
    pairs = few.select(*by, "need", F.col("name").alias("a")).join(few.select(*by, F.col("name").alias("b")), by).filter("a < b")
    tied = _tied(pairs, by)
    many = held.filter(F.col("_n") > paired).drop("_n")
    return tied.unionByName(_large_groups(many, by, rounds)) if many.limit(1).count() else tied


def _tied(pairs: DataFrame, by: list[str]) -> DataFrame:
    alike = pairs.withColumn("ratio", S.fuzzy_ratio("a", "b")).filter("ratio >= need")
    return alike.select(*by, F.explode(F.array("a", "b")).alias("name"), F.concat_ws("\u0002", F.lit("2"), "a", "b").alias("hub"))


def _large_groups(names: DataFrame, by: list[str], rounds: int, leads: int = 8) -> DataFrame:
    alone, stars = names, None
    for _ in range(rounds):
        lead = top_per_key(alone, by, [F.xxhash64("name"), F.col("name")], leads).select(*by, F.col("name").alias("lead"))
        seen = names.join(lead, by).withColumn("ratio", F.when(F.col("name") == F.col("lead"), 100.0).otherwise(S.fuzzy_ratio("name", "lead")))
        got = cut_lineage(seen.filter("ratio >= need").select(*by, "name", F.concat(F.lit("1"), F.col("lead")).alias("hub")))
        stars = got if stars is None else stars.unionByName(got)
        alone = alone.join(got.select(*by, "name").distinct(), [*by, "name"], "left_anti")
    at = F.concat_ws("\u0002", *by, "name")
    roots = components(names.select(at.alias("surface")), stars.select(at.alias("surface"), F.concat_ws("\u0002", *by, "hub").alias("hub")))
    rooted = cut_lineage(names.withColumn("surface", at).join(roots, "surface").drop("surface"))
    keyed = rooted.select(*by, F.col("name").alias("id"), "root", "need", F.explode(F.array_distinct(F.array("name", F.array_join(
        F.array_distinct(F.filter(F.split("name", " "), lambda w: w != "")), " ")))).alias("key"))
    ratio = F.col("need") / 100
    met = letter_candidates(keyed, keyed, ratio, by, "root").unionByName(cover_candidates(keyed.filter("id = key"), ratio, by, "root"))
    ends = met.select(*by, F.least("lid", "rid").alias("a"), F.greatest("lid", "rid").alias("b")).distinct()
    side = lambda c: rooted.select(*by, F.col("name").alias(c), F.col("root").alias(f"root_{c}"), *(["need"] if c == "a" else []))
    good = ends.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).withColumn("ratio", S.fuzzy_ratio("a", "b")).filter("ratio >= need")
    one = good.groupBy(*by, "root_a", "root_b").agg(F.min(F.struct("a", "b")).alias("p"))
    return stars.unionByName(one.select(*by, F.explode(F.array("p.a", "p.b")).alias("name"), F.concat_ws("\u0002", F.lit("2"), "p.a", "p.b").alias("hub")))


def name_suggestions(unmatched: DataFrame, listed: DataFrame) -> DataFrame:
    """Up to two listed names most alike an unmatched one: indel ratio, 0.85 at least where one contains the other, from 0.6 on.

    First contained names and, by letter pairs, all with a ratio of ``SURE`` or more. A name that has two of
    these is done, as no other can be more alike; the rest is looked up by letters down to 0.6. Names that are alike as a family
    are compared block by block instead. Equal to comparing all.
    """
    names = cut_lineage(listed.select(T.norm_name(F.col("name")).alias("id")).filter("id <> ''").distinct().withColumn("key", F.col("id")))
    base = cut_lineage(unmatched.select("place_name", T.norm_name(F.col("place_name")).alias("key")).filter("key <> ''"))
    asked = cut_lineage(base.select(F.col("key").alias("id"), "key").distinct())
    pairs = sparse_candidates(asked, names, SURE)
    if pairs is None:
        return _suggested(base, closest(asked, names, 100 * vocab.NAME_SUGGEST, 2, contained=85.0).withColumn("similarity", F.col("similarity") / 100))
    text, term = (lambda df: df.select("id", F.col("key").alias("text"))), (lambda df: df.select(F.col("id").alias("term_id"), F.col("key").alias("term")))
    inside = containment_pairs(text(names), term(asked)).select(F.col("term_id").alias("lid"), F.col("id").alias("rid")).unionByName(
        containment_pairs(text(asked), term(names)).select(F.col("id").alias("lid"), F.col("term_id").alias("rid"))).distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        holds = F.contains("lid", F.col("rid")) | F.contains("rid", F.col("lid"))
        ratio = pairs.withColumn("ratio", S.indel_ratio("lid", "rid") / 100)
        return ratio.select("lid", "rid", F.when(holds, F.greatest("ratio", F.lit(0.85))).otherwise(F.col("ratio")).alias("similarity"))

    near = cut_lineage(scored(pairs.unionByName(inside).distinct()).filter(F.col("similarity") >= SURE))
    done = near.groupBy("lid").agg(F.count(ONE).alias("n")).filter("n > 1").select(F.col("lid").alias("id"))
    rest = asked.join(done, "id", "left_anti")
    far = scored(letter_candidates(rest, names, F.lit(vocab.NAME_SUGGEST))).filter((F.col("similarity") >= vocab.NAME_SUGGEST) & (F.col("similarity") < SURE))
    top = top_per_key(near.unionByName(far), ["lid"], [F.desc("similarity"), F.asc("rid")], 2)
    return _suggested(base, top)


def _suggested(base: DataFrame, top: DataFrame) -> DataFrame:
    return base.join(top.withColumnRenamed("lid", "key"), "key").select(
        "place_name", "rank", F.bround("similarity", 2).alias("similarity"), F.col("rid").alias("suggestion"))
