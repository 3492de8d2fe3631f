"""Spelling variants resolved to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import normalize_bangla, phonetic_key, script_counts
from roamlens.functions.tasks import walk_claims
from roamlens.operators.alike import alike_groups
from roamlens.operators.joins import official_form, pair_signals, token_subset_pairs
from roamlens.operators.links import components
from roamlens.session import broadcast_if_small, cut_lineage, first_per_key, global_row_number

ONE = "*"  # counted rows


def _empty() -> Column:
    return F.array().cast("array<string>")


def reviewed_key(surface: Column) -> Column:
    return F.lower(normalize_bangla(surface))


def equivalents(lexicon: DataFrame, bangla_names: DataFrame, spellings: DataFrame) -> DataFrame:
    """(entity_type, key, target) from the accepted rows of the three reviewed lists."""
    ok = F.trim("decision") == "accept"
    rows = lexicon.filter(ok).select(F.upper("entity_type").alias("entity_type"), reviewed_key(F.col("surface")).alias("key"), F.col("concept").alias("target"), F.lit(0).alias("o"))
    rows = rows.unionByName(bangla_names.filter(ok).select(F.lit("PLACE").alias("entity_type"), reviewed_key(F.col("bangla")).alias("key"), F.col("place").alias("target"), F.lit(1).alias("o")))
    rows = rows.unionByName(spellings.filter(ok).select(F.lit("PLACE").alias("entity_type"), reviewed_key(F.col("variant")).alias("key"), F.col("place").alias("target"), F.lit(2).alias("o")))
    return rows.groupBy("entity_type", "key").agg(F.max_by("target", F.struct("o", "target")).alias("target"))


def surface_groups(mentions: DataFrame, reviews: DataFrame, official: DataFrame, equivalent: DataFrame) -> DataFrame:
    """One row per surface with its geography and languages; unseen official names with no mentions.

    Districts, divisions and languages are small closed sets, so their sets stay small; distinct
    reviews are counted, not collected.
    """
    r = reviews.select("review_id", "district", "division")
    pair = mentions.select("surface", "entity_type", "review_id", "language").groupBy("surface", "review_id").agg(
        F.min("entity_type").alias("entity_type"), F.collect_set("language").alias("l"), F.count(ONE).alias("m"))
    seen = pair.join(r, "review_id", "left").groupBy("surface").agg(
        F.min("entity_type").alias("entity_type"), F.sum("m").alias("mentions"), F.count(ONE).alias("n_reviews"),
        F.array_sort(F.collect_set("district")).alias("districts"), F.array_sort(F.collect_set("division")).alias("divisions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("languages"))
    o = official.filter("place_name IS NOT NULL").groupBy(F.col("place_name").alias("surface")).agg(
        F.array_sort(F.collect_set("district")).alias("od"), F.array_sort(F.collect_set("division")).alias("ov"))
    j = seen.join(o, "surface", "full_outer")
    base = j.select(
        "surface", F.coalesce("entity_type", F.lit("PLACE")).alias("entity_type"), F.coalesce("mentions", F.lit(0)).alias("mentions"),
        F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"),
        F.array_sort(F.array_union(F.coalesce("districts", _empty()), F.coalesce("od", _empty()))).alias("districts"),
        F.array_sort(F.array_union(F.coalesce("divisions", _empty()), F.coalesce("ov", _empty()))).alias("divisions"),
        F.coalesce("languages", _empty()).alias("languages")).withColumn("key", reviewed_key(F.col("surface")))
    return describe(base.join(broadcast_if_small(equivalent), ["entity_type", "key"], "left").drop("key"))


def describe(groups: DataFrame) -> DataFrame:
    """The parts of a surface that pair rules look at."""
    norm = F.lower(T.strip_qualifier(F.col("surface")))
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")))
    g = groups.withColumn("normalized", norm).withColumn("phonetic_key", phonetic_key(F.col("surface")))
    bn, la = script_counts(F.col("normalized"))
    return g.withColumn("key_tokens", words(F.col("phonetic_key"))).withColumn("name_tokens", words(F.col("normalized"))).withColumn("bengali", bn > la)


# ---- links ----------------------------------------------------------------------------------
def _hub(*parts: Column) -> Column:
    return F.concat_ws("\u0002", *parts)


def merge_links(groups: DataFrame, pairs_key: str = "surface") -> DataFrame:
    """Edges whose connected components are the single-link clusters at the merge threshold.

    With weights .40/.25/.20/.15 and threshold .72 a pair merges only in these cases, where
    p, s, c, g are the phonetic, string, containment and geography signals:

    * same script, c = 1 (then s = 1): p = 1, or p = .75 and g >= 0;
    * same script, c = 0: p = 1 and (g = 1 and s >= .7, or g = .6 and s >= .92);
    * across scripts: p = 1 and g >= 0, or p = .75 and g = 1.

    Where a rule joins everything on one side with everything on the other, both sides are
    tied to one hub node: as many edges as members, never a pair list. The string rule
    compares distinct names with one sound key inside one district or division (``alike_groups``).
    """
    g = groups.select("surface", "entity_type", "normalized", "key_tokens", "name_tokens", "bengali", "districts", "divisions", "target")
    key = F.array_join("key_tokens", " ")
    g = g.withColumn("k", key).filter("k <> ''")
    here = g.withColumn("area", F.explode(F.concat(
        F.transform("districts", lambda d: F.concat(F.lit("d:"), d)), F.transform("divisions", lambda d: F.concat(F.lit("v:"), d)))))
    edges: list[DataFrame] = []

    def tie(df: DataFrame, hub: Column) -> None:
        edges.append(df.select("surface", hub.alias("hub")))

    # Equal names differing in case or qualifier, sharing a district or division: s = 1, p = 1.
    tie(here, _hub(F.lit("same"), "entity_type", F.col("bengali").cast("string"), "k", "normalized", "area"))

    # One sound key in two scripts: every Bangla surface meets every Latin one where g >= 0.
    both = lambda df, by: df.join(
        df.groupBy(*by).agg(F.count_distinct("bengali").alias("scripts")).filter("scripts = 2").select(*by), by, "left_semi")
    tie(both(here, ["entity_type", "k", "area"]), _hub(F.lit("cross"), "entity_type", "k", "area"))
    nowhere = F.size("districts") == 0
    for side in (True, False):
        lost = g.filter(nowhere & (F.col("bengali") == side))
        keys = lost.select("entity_type", "k").distinct()
        partner = g.filter(F.col("bengali") != side).join(keys, ["entity_type", "k"], "left_semi")
        full = lost.join(partner.select("entity_type", "k").distinct(), ["entity_type", "k"], "left_semi")
        hub = _hub(F.lit(f"nowhere{side}"), "entity_type", "k")
        tie(full, hub)
        tie(partner, hub)

    # Across scripts with one key's sounds inside the other's: only where a district is shared.
    d = here.filter("area LIKE 'd:%'").select("entity_type", "area", "k", "key_tokens", "bengali", "surface")
    keys = d.select("entity_type", "area", "k", "key_tokens", "bengali").distinct()
    sub = _subset_keys(keys, ["entity_type", "area"], "key_tokens", "k", F.col("l.bengali") != F.col("r.bengali"))
    sub = sub.select("entity_type", "area", F.col("lk").alias("ka"), F.col("lside").alias("sa"), F.col("rk").alias("kb"), F.col("rside").alias("sb"))
    hub = lambda: _hub(F.lit("xsub"), "entity_type", "area", "ka", F.col("sa").cast("string"), "kb")
    for kk, side in (("ka", "sa"), ("kb", "sb")):
        m = d.withColumnRenamed("k", kk).withColumnRenamed("bengali", side).join(sub, ["entity_type", "area", kk, side])
        tie(m, hub())

    # Official forms: equal words apart from kind-of-place words on one side.
    cats = F.array(*[F.lit(w) for w in vocab.CATEGORY_WORDS])
    w = g.withColumn("w", F.array_join("name_tokens", " ")).withColumn("core", F.array_join(F.array_except("name_tokens", cats), " "))
    sets = w.select("entity_type", "bengali", "core", "w", "name_tokens", "k", "key_tokens").distinct()
    a = sets.select("entity_type", "bengali", "core", *[F.col(c).alias(f"a_{c}") for c in ("w", "name_tokens", "k", "key_tokens")])
    b = sets.select("entity_type", "bengali", "core", *[F.col(c).alias(f"b_{c}") for c in ("w", "name_tokens", "k", "key_tokens")])
    off = a.join(b, ["entity_type", "bengali", "core"]).filter(F.size("a_name_tokens") < F.size("b_name_tokens")).filter(
        official_form(F.col("a_name_tokens"), F.col("b_name_tokens")))
    inside = (F.size(F.array_except("a_key_tokens", "b_key_tokens")) == 0) | (F.size(F.array_except("b_key_tokens", "a_key_tokens")) == 0)
    off = off.filter(inside).withColumn("equal_key", F.col("a_k") == F.col("b_k"))
    pair = ["entity_type", "bengali", "a_w", "a_k", "b_w", "b_k"]
    for end in ("a", "b"):
        m = w.withColumnRenamed("w", f"{end}_w").withColumnRenamed("k", f"{end}_k").join(
            off.select(*pair, "equal_key"), ["entity_type", "bengali", f"{end}_w", f"{end}_k"])
        base = [F.lit("off"), F.col("entity_type"), F.col("bengali").cast("string"), F.col("a_w"), F.col("a_k"), F.col("b_w"), F.col("b_k")]
        tie(m.filter("equal_key"), _hub(*base))
        part = m.filter("NOT equal_key")
        areas = part.withColumn("area", F.explode(F.concat(
            F.transform("districts", lambda x: F.concat(F.lit("d:"), x)), F.transform("divisions", lambda x: F.concat(F.lit("v:"), x)))))
        tie(areas, _hub(*base, F.col("area")))
        # A side without districts meets all of the other side (g = 0).
        tie(part if end == "b" else part.filter(nowhere), _hub(*base, F.lit("a-nowhere")))
        tie(part if end == "a" else part.filter(nowhere), _hub(*base, F.lit("b-nowhere")))

    # Hubs holding one side only join nothing that is not joined by rule, so they are removed.
    star = None
    for e in edges:
        star = e if star is None else star.unionByName(e)
    star = _drop_one_sided(star.distinct(), w)

    # Same sound, same area, alike spelling: distinct names only, tied to hubs without pairing a group.
    by = ["entity_type", "bengali", "k", "area"]
    names = here.select(*by, F.col("normalized").alias("name")).distinct().withColumn("need", F.when(F.col("area").startswith("d:"), 70.0).otherwise(92.0))
    hub = _hub(F.lit("alike"), "entity_type", F.col("bengali").cast("string"), "k", "area", "hub")
    rows = alike_groups(names, by).select(*by, F.col("name").alias("normalized"), hub.alias("hub"))
    star = star.unionByName(here.join(rows, [*by, "normalized"]).select("surface", "hub"))

    return star.unionByName(_reviewed_links(groups)).distinct()


def _reviewed_links(groups: DataFrame) -> DataFrame:
    """Reviewed spellings of one target, and the target itself when it is a surface."""
    t = groups.filter("target IS NOT NULL").select("surface", _hub(F.lit("reviewed"), "entity_type", F.lower("target")).alias("hub"))
    own = groups.select("surface", _hub(F.lit("reviewed"), "entity_type", F.lower("surface")).alias("hub")).join(
        t.select("hub").distinct(), "hub", "left_semi").select("surface", "hub")
    return t.unionByName(own)


def _drop_one_sided(star: DataFrame, w: DataFrame) -> DataFrame:
    """Official-form hubs whose members all carry one of the two names are dropped."""
    kind = F.substring_index("hub", "\u0002", 1)
    name = w.select("surface", F.concat_ws("\u0003", "w", "k").alias("wk"))
    off = star.filter(kind == "off").join(name, "surface")
    full = off.groupBy("hub").agg(F.count_distinct("wk").alias("n")).filter("n = 2").select("hub")
    return star.filter(kind != "off").unionByName(off.join(full, "hub", "left_semi").select("surface", "hub"))


def _subset_keys(keys: DataFrame, by: list[str], tokens: str, name: str, condition: Column) -> DataFrame:
    """Key pairs where one token set lies strictly inside another, met through its rarest token."""
    part = by + [tokens, name, "bengali"]
    r = keys.select(*part).withColumn("tok", F.explode(tokens))
    df = r.groupBy(*by, "tok").agg(F.count(ONE).alias("df"))
    l = r.join(df, by + ["tok"]).groupBy(*by, tokens, name, "bengali").agg(F.min_by("tok", F.struct("df", "tok")).alias("tok"))
    j = l.alias("l").join(r.alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in by), F.col("l.tok") == F.col("r.tok")])
    strict = (F.size(F.array_except(f"l.{tokens}", f"r.{tokens}")) == 0) & (F.size(f"l.{tokens}") < F.size(f"r.{tokens}"))
    return j.filter(strict & condition).select(
        *[F.col(f"l.{c}").alias(c) for c in by], F.col(f"l.{name}").alias("lk"), F.col("l.bengali").alias("lside"),
        F.col(f"r.{name}").alias("rk"), F.col("r.bengali").alias("rside"))


# ---- clusters ---------------------------------------------------------------------------------
def resolve(groups: DataFrame) -> DataFrame:
    """Cluster of every surface. The groups feed many rules, so they are written once."""
    groups = cut_lineage(groups)
    return components(groups, merge_links(groups))


def resolve_with_vectors(groups: DataFrame, vectors: DataFrame, threshold: float = vocab.MERGE_THRESHOLD) -> DataFrame:
    """Clusters when a pair's score is averaged with the cosine of its vectors (surface, embedding); pairs without both keep theirs.

    A cosine is one at most, so a merging pair needs a score of 2 * threshold - 1 by itself. Geography and spelling reach 0.40 of that, so its sound
    keys or its words lie inside each other: those pairs meet under the rarest token, get all signals, and no other pair is scored. Equal to scoring all.
    """
    g = cut_lineage(groups)
    unit = vectors.groupBy("surface").agg(F.first("embedding").alias("v")).select("surface", S.unit(F.col("v")).alias("u"))
    met = None
    for tokens in ("key_tokens", "name_tokens"):
        side = g.filter(F.size(tokens) > 0).select(F.col("surface").alias("id"), F.transform(tokens, lambda x: F.concat("entity_type", F.lit("\u0002"), x)).alias("tokens"))
        pairs = token_subset_pairs(side, side).filter("id <> rid").select(F.least("id", "rid").alias("a_id"), F.greatest("id", "rid").alias("b_id"))
        met = pairs if met is None else met.unionByName(pairs)
    cols = ["normalized", "key_tokens", "name_tokens", "bengali", "districts", "divisions"]
    full = cut_lineage(g.join(unit, "surface", "left").select("surface", F.struct(*cols).alias("x"), "u"))
    ends = [full.select(F.col("surface").alias(f"{c}_id"), F.col("x").alias(c), F.col("u").alias(f"{c}_u")) for c in "ab"]
    pairs = met.distinct().join(ends[0], "a_id").join(ends[1], "b_id").withColumn("cosine", S.dot(F.col("a_u"), F.col("b_u")))
    good = pair_signals(pairs, "cosine").filter(F.col("score") >= threshold - 1e-12)
    links = good.select(F.explode(F.array("a_id", "b_id")).alias("surface"), _hub(F.lit("pair"), "a_id", "b_id").alias("hub"))
    return components(g, links.unionByName(_reviewed_links(g)))


# ---- stable ids ----------------------------------------------------------------------------------
def _claimed(claims: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    """(root, entity_id) decided in rounds and the claims still open: a root may take its lowest open id if no earlier root asks for it."""
    won_all, open_claims, done = None, claims, 0
    while rounds is None or done < rounds:
        bid = open_claims.groupBy("root").agg(F.min_by("entity_id", F.struct("no", "entity_id")).alias("entity_id"))
        first = open_claims.groupBy("entity_id").agg(F.min("root").alias("root"))
        won = cut_lineage(bid.join(first, ["entity_id", "root"]).select("root", "entity_id"))
        if not won.limit(1).count():
            break
        won_all = won if won_all is None else won_all.unionByName(won)
        open_claims = cut_lineage(open_claims.join(won.select("root"), "root", "left_anti").join(won.select("entity_id"), "entity_id", "left_anti"))
        done += 1
    return (claims.select("root", "entity_id").limit(0) if won_all is None else won_all), open_claims


def solve_claims(claims: DataFrame, rounds: int = 3, largest: int = 1_000_000) -> DataFrame:
    """(root, entity_id): root after root in order takes its lowest id that no earlier root took; claims hold (root, entity_id, no).

    A few rounds over all claims settle nearly all. What is left are chains, where each root waits for the one before; their links are followed by doubling
    (``components``), and each chain of at most ``largest`` claims is then walked in order inside one task. Longer ones go on in rounds.
    """
    won, left = _claimed(claims, rounds)
    if not left.limit(1).count():
        return won
    nodes = left.select(F.col("root").alias("surface")).distinct()
    chain = cut_lineage(left.join(components(nodes, left.select(F.col("root").alias("surface"), F.col("entity_id").alias("hub"))).select(
        F.col("surface").alias("root"), F.col("root").alias("chain")), "root"))
    size = chain.groupBy("chain").agg(F.count(ONE).alias("n"))
    kind = "root string, entity_id string"
    short = chain.join(size.filter(F.col("n") <= largest).select("chain"), "chain", "left_semi")
    walked = short.groupBy("chain").applyInPandas(walk_claims, kind)
    long = chain.join(size.filter(F.col("n") > largest).select("chain"), "chain", "left_semi").drop("chain")
    return won.unionByName(walked).unionByName(_claimed(cut_lineage(long), None)[0])


def assign_ids(clusters: DataFrame, registry: DataFrame, next_number: Column | None = None) -> DataFrame:
    """(root, entity_id, status): a cluster keeps the lowest id its members hold.

    A known id claimed by two clusters goes to the first root in order, the other takes its next one (``solve_claims``); clusters left without an
    id get new numbers. ``registry`` holds (surface, entity_id).
    """
    num = F.regexp_replace("entity_id", "^E", "").cast("long")
    claims = cut_lineage(clusters.join(registry, "surface").select("root", "entity_id", num.alias("no")).distinct())
    roots = clusters.select("root").distinct()
    kept = cut_lineage(solve_claims(claims))
    fresh = roots.join(kept.select("root"), "root", "left_anti")
    top = registry.agg(F.coalesce(F.max(num), F.lit(0)).alias("m")).scalar() if next_number is None else next_number - 1
    numbered = global_row_number(fresh, [F.asc("root")], "n").select(
        "root", F.concat(F.lit("E"), F.lpad((F.col("n") + top).cast("string"), 4, "0")).alias("entity_id"), F.lit("new").alias("status"))
    return kept.select("root", "entity_id", F.lit("kept").alias("status")).unionByName(numbered)


def retired_ids(clusters: DataFrame, registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Known ids no cluster kept, with the id their surfaces live on in."""
    held = clusters.join(registry, "surface").select("root", "entity_id").distinct()
    lost = held.join(ids.select("entity_id"), "entity_id", "left_anti")
    return lost.join(ids.select("root", F.col("entity_id").alias("survivor")), "root").groupBy("entity_id").agg(
        F.min_by("survivor", "root").alias("survivor"))


def entity_tables(groups: DataFrame, clusters: DataFrame, ids: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and their variants; a reviewed name is preferred for display."""
    m = groups.join(clusters, "surface").join(ids.select("root", "entity_id"), "root")
    best = F.struct((-F.col("mentions")).alias("m"), (-F.length("surface")).alias("l"), F.col("surface"))
    targets = m.filter("target IS NOT NULL").groupBy("entity_id", "target").agg(F.sum("mentions").alias("t"))
    display = targets.groupBy("entity_id").agg(F.min_by("target", F.struct((-F.col("t")).alias("t"), F.col("target"))).alias("display"))
    g = m.groupBy("entity_id").agg(
        F.min_by(F.struct("surface", "entity_type"), best).alias("c"), F.count(ONE).alias("n_variants"), F.sum("mentions").alias("n_mentions"))
    # Districts, divisions and labels are closed sets; values are united, not whole arrays.
    def tagged(kind: str):
        return F.transform(kind, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    value = F.explode(F.concat(*[tagged(c) for c in ("districts", "divisions", "languages")]))
    parts = m.select("entity_id", value.alias("x")).groupBy("entity_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("x.kind") == c, F.col("x.v")))).alias(c) for c in ("districts", "divisions", "languages")])
    g = g.join(parts, "entity_id", "left")
    per_review = mentions.select("surface", "review_id").distinct().join(m.select("surface", "entity_id"), "surface")
    reviews = per_review.groupBy("entity_id").agg(F.count_distinct("review_id").alias("n_reviews"))
    entities = g.join(display, "entity_id", "left").join(reviews, "entity_id", "left").select(
        "entity_id", F.coalesce("display", "c.surface").alias("canonical_name"), F.col("c.entity_type").alias("entity_type"), "n_variants",
        "n_mentions", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"),
        *[F.coalesce(c, _empty()).alias(c) for c in ("districts", "divisions", "languages")])
    variants = m.join(g.select("entity_id", F.col("c.surface").alias("top")), "entity_id").select(
        "entity_id", "surface", "mentions", "phonetic_key", (F.col("surface") == F.col("top")).alias("is_canonical"))
    return entities, variants


# ---- evaluation -----------------------------------------------------------------------------------
def bcubed(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """B-cubed precision, recall, F1 and purity from cell counts instead of item pairs."""
    items = predicted.select("item", "cluster").join(gold.select("item", "label"), "item")
    cell = items.groupBy("cluster", "label").agg(F.count(ONE).alias("n"))
    c = cell.groupBy("cluster").agg(F.sum("n").alias("c"), F.max("n").alias("best"))
    l = cell.groupBy("label").agg(F.sum("n").alias("l"))
    sums = cell.join(c, "cluster").join(l, "label").agg(
        F.sum(F.col("n") * F.col("n") / F.col("c")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("l")).alias("r"), F.sum("n").alias("n"))
    purity = c.agg(F.sum("best")).scalar()
    p, r = F.col("p") / F.col("n"), F.col("r") / F.col("n")
    return sums.select(
        F.col("n").alias("n_items"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4).alias("f1"), F.round(purity / F.col("n"), 4).alias("purity"))


def merge_kinds(variants: DataFrame) -> DataFrame:
    """Merged entities, by whether their spellings differ in more than letter case."""
    g = variants.groupBy("entity_id").agg(F.count(ONE).alias("n_variants"), F.count_distinct(F.lower("surface")).alias("n_spellings"))
    return g.filter("n_variants > 1").withColumn("kind", F.when(F.col("n_spellings") > 1, "substantive").otherwise("case only"))
