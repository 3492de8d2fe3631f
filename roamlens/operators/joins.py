"""Dimension joins, table builds, blocked pairs and pair scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import similarity as S
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import script_shares
from roamlens.functions.tasks import lcs_rows
from roamlens.operators import vectors
from roamlens.session import broadcast_if_small, cut_lineage, first_per_key, global_row_number, top_per_key

ONE = "*"  # counted rows


# ---- review spine ------------------------------------------------------------------------
def review_spine(reviews: DataFrame, places: DataFrame, topics: DataFrame, topic_map: DataFrame,
                 preferences: DataFrame, all_ranks: bool = False) -> DataFrame:
    """One row per review with its place, topic and preference.

    With ``all_ranks`` a review whose topic maps to two preferences appears under each.
    """
    m = topic_map if all_ranks else topic_map.filter("mapping_rank = 1")
    m = m.select("topic_id", "preference_id", F.col("similarity").alias("mapping_similarity"),
                 F.col("confidence").alias("mapping_confidence"))
    p = places.select("place_id", "place_name", "city", "district", "division", "category", "place_kind")
    t = topics.select("topic_id", "interpreted_label")
    pr = preferences.select("preference_id", "preference_label",
                            F.col("category").alias("preference_category"),
                            F.col("subcategory").alias("preference_subcategory"), "preference_type")
    taxonomy = m.join(broadcast_if_small(pr), "preference_id", "left")
    return (
        reviews.join(broadcast_if_small(p), "place_id", "left")
        .join(broadcast_if_small(t), "topic_id", "left")
        .join(broadcast_if_small(taxonomy), "topic_id", "left")
    )


def mention_evidence(mentions: DataFrame, entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per mention with its entity and the place its review is about."""
    e = entities.select("entity_id", "canonical_name")
    r = reviews.select("review_id", F.col("place_name").alias("found_in_place"),
                       F.col("district").alias("found_in_district"),
                       F.col("division").alias("found_in_division"), "review_rating", "review_date")
    return mentions.join(broadcast_if_small(e), "entity_id", "left").join(r, "review_id", "left")


def attach_entities(mentions: DataFrame, variants: DataFrame) -> DataFrame:
    """entity_id by (type, surface); unresolved mentions keep NULL."""
    v = variants.select("entity_type", "surface", "entity_id")
    return mentions.join(broadcast_if_small(v), ["entity_type", "surface"], "left")


def unresolved(mentions: DataFrame, variants: DataFrame) -> DataFrame:
    return attach_entities(mentions, variants).groupBy("entity_type").agg(
        F.count(ONE).alias("n_mentions"), F.count_if(F.col("entity_id").isNull()).alias("n_unresolved"))


# ---- table builds -------------------------------------------------------------------------
def _mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, smallest on a tie, from two combinable aggregates."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(ONE).alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias(value))


def places_build(reviews: DataFrame, geography: DataFrame) -> DataFrame:
    """One row per reviewed place name, enriched from the geography table."""
    base = reviews.groupBy("place_name").agg(
        F.min_by("city", F.when(T.blank_to_null(F.col("city")).isNotNull(), F.col("row_order"))).alias("csv_city"),
        F.max("place_avg_rating").alias("place_avg_rating"),
        F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.col("row_order"))).alias("source_url"),
    )
    agg = base.join(_mode(reviews, "place_name", "category"), "place_name", "left").join(
        _mode(reviews, "place_name", "source"), "place_name", "left")
    g = geography.select("place_name", F.col("city").alias("geo_city"), "district", "division",
                         F.col("place_kind").alias("geo_kind"), "lat", "lng", F.lit(1).alias("hit"))
    lodging = F.lower(F.coalesce("category", F.lit(""))).rlike("hotel|resort|inn|guest")
    derived = F.when(lodging, "accommodation").otherwise("attraction")
    return agg.join(broadcast_if_small(g), "place_name", "left").select(
        "place_name", F.coalesce("geo_city", "csv_city").alias("city"), "district", "division", "category",
        F.coalesce("geo_kind", derived).alias("place_kind"), "source", "place_avg_rating", "source_url",
        F.coalesce("hit", F.lit(0)).alias("geo_resolved"), "lat", "lng")


def places_unmatched(reviews: DataFrame, geography: DataFrame) -> DataFrame:
    """Names on one side only: reviewed without geography, or listed without reviews."""
    names = reviews.select("place_name").distinct()
    listed = geography.select("place_name").distinct()
    return names.join(listed, "place_name", "left_anti").withColumn("issue", F.lit("no geography")).unionByName(
        listed.join(names, "place_name", "left_anti").withColumn("issue", F.lit("no reviews")))


def reviews_build(processed: DataFrame, with_topics: DataFrame, places: DataFrame) -> DataFrame:
    """Serving review rows: topics where known, place id, date parts, first row per id."""
    topic = with_topics.select("review_id", "topic_id")
    have = first_per_key(processed, ["review_id"], F.col("row_order"))
    place = places.select("place_name", "place_id")
    day = F.coalesce(*[F.try_to_timestamp("review_date", F.lit(f)) for f in (
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
        "dd/MM/yyyy")])
    return (
        have.join(topic, "review_id", "left").join(broadcast_if_small(place), "place_name", "left")
        .withColumn("day", day)
        .select(
            "review_id", "place_id", "topic_id", "source", "review_rating", "review_text_clean",
            F.date_format("day", "yyyy-MM-dd").alias("review_date"),
            F.date_format("day", "yyyy-MM").alias("review_month"), F.year("day").alias("review_year"),
            F.length(F.coalesce("review_text_clean", F.lit(""))).alias("text_length"),
            T.to_bool(F.col("reviewer_is_local_guide")).alias("reviewer_is_local_guide"))
    )


def gems_build(scores: DataFrame, lookups: DataFrame, queue: DataFrame, mentions: DataFrame,
               reviews: DataFrame, host_points: DataFrame) -> DataFrame:
    """Scored entities with visibility, coordinates and decision.

    An undocumented entity without a point takes that of the place whose reviews mention it
    most; a documented one stays unplaced.
    """
    geo = lookups.select("entity_id", "visibility_reason", "maps_place", "maps_review_count", "lat", "lng")
    dec = queue.select("entity_id", "divisions", "state", "publishable", "decided_by", "decided_at_utc",
                       F.col("reason").alias("decision_reason"))
    hosts = (
        mentions.select("entity_id", "review_id").join(reviews.select("review_id", "place_name"), "review_id")
        .groupBy("entity_id", "place_name").agg(F.count(ONE).alias("n"))
        .join(broadcast_if_small(host_points.filter("lat IS NOT NULL")), "place_name")
    )
    top = hosts.groupBy("entity_id").agg(F.min_by(
        F.struct("place_name", F.col("lat").alias("hlat"), F.col("lng").alias("hlng")),
        F.struct((-F.col("n")).alias("n"), F.col("place_name"))).alias("h"))
    borrow = F.col("lat").isNull() & (F.col("visibility") == "V0") & F.col("h").isNotNull()
    return (
        scores.join(geo, "entity_id", "left").join(dec, "entity_id", "left").join(top, "entity_id", "left")
        .withColumn("borrow", borrow)
        .withColumn("coord_source", F.when(F.col("borrow"), "near_host_place")
                    .when(F.col("lat").isNotNull(), "lookup"))
        .withColumn("near_place", F.when(F.col("borrow"), F.col("h.place_name")))
        .withColumn("lat", F.when(F.col("borrow"), F.col("h.hlat")).otherwise(F.col("lat")))
        .withColumn("lng", F.when(F.col("borrow"), F.col("h.hlng")).otherwise(F.col("lng")))
        .withColumn("state", F.coalesce("state", F.lit("candidate")))
        .withColumn("publishable", F.coalesce(F.col("publishable").cast("int"), F.lit(0)))
        .drop("borrow", "h")
    )


def gem_ranks(gems: DataFrame) -> DataFrame:
    """Rank by score, best first, unscored last, entity id breaking ties."""
    return global_row_number(gems, [F.desc_nulls_last("gem_score"), F.asc("entity_id")], "gem_rank")


def recent_bound(reviews: DataFrame, years: int = vocab.RECENCY_WINDOW_YEARS) -> Column:
    """First day inside the recency window, measured from the newest review."""
    return reviews.agg(F.add_months(F.max("review_date"), -12 * years).alias("d")).scalar()


# ---- place lists ----------------------------------------------------------------------------
def match_existing(names: DataFrame, listed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Existing names to list entries: an alias beats the name, a merged id leads to its main id."""
    ids = listed.select("place_id", F.explode(F.concat(
        F.array("place_id"), F.coalesce("other_place_ids", F.array().cast("array<string>")))).alias("any_id"))
    by_alias = aliases.select(T.norm_name(F.col("alias")).alias("key"), F.col("place_id").alias("any_id")).join(
        broadcast_if_small(ids), "any_id").groupBy("key").agg(F.max("place_id").alias("alias_id"))
    by_name = listed.select(T.norm_name(F.col("name")).alias("key"), F.col("place_id")).groupBy("key").agg(
        F.max("place_id").alias("name_id"))
    return (
        names.withColumn("key", T.norm_name(F.col("place_name")))
        .join(broadcast_if_small(by_alias), "key", "left").join(broadcast_if_small(by_name), "key", "left")
        .select("place_name", F.coalesce("alias_id", "name_id").alias("place_id"),
                F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("name_id").isNotNull(), "same name")
                .otherwise("unmatched").alias("basis"),
                F.coalesce(F.col("alias_id") != F.col("name_id"), F.lit(False)).alias("ambiguous"))
    )


def gazetteer_match(entities: DataFrame, variants: DataFrame, listed: DataFrame, spellings: DataFrame) -> DataFrame:
    """The listed place an entity's spellings refer to, in priority order.

    Keys: accepted misspelling, then a listed or alias name, then a derived shorter form.
    """
    own = listed.select("canonical_name", "reviews", "list_order", F.explode(F.array_compact(F.array_distinct(
        F.concat(F.array("canonical_name", "list_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    )).alias("name"))
    forms = own.select("canonical_name", "reviews", "list_order", F.lit(0).alias("kind"),
                       T.core_name(F.col("name")).alias("key")).unionByName(
        own.select("canonical_name", "reviews", "list_order", F.lit(1).alias("kind"),
                   F.explode(T.query_forms(F.col("name"))).alias("form"))
        .select("canonical_name", "reviews", "list_order", "kind", T.core_name(F.col("form")).alias("key")))
    keys = forms.filter("key <> ''").groupBy("key").agg(F.min_by(
        F.struct("canonical_name", "reviews"), F.struct("kind", "list_order")).alias("hit"))
    fixed = spellings.filter("decision = 'accept'").select(
        T.core_name(F.col("variant")).alias("key"), T.core_name(F.col("place")).alias("to_key"))
    fixed = fixed.groupBy("key").agg(F.max("to_key").alias("to_key"))
    names = entities.select("entity_id", F.lit(-1).cast("bigint").alias("pos"), F.col("canonical_name").alias("n"))
    names = names.unionByName(variants.select("entity_id", (-F.col("mentions")).alias("pos"), F.col("surface").alias("n"))
                              .withColumn("pos", F.col("pos") + 1000000000))
    look = (
        names.withColumn("key", T.core_name(F.col("n")))
        .join(broadcast_if_small(fixed), "key", "left")
        .withColumn("key2", F.col("to_key"))
        .join(broadcast_if_small(keys.select("key", F.col("hit").alias("direct"))), "key", "left")
        .join(broadcast_if_small(keys.select(F.col("key").alias("key2"), F.col("hit").alias("respelled"))), "key2", "left")
        .withColumn("hit", F.coalesce("respelled", "direct"))
        .filter("hit IS NOT NULL")
    )
    return look.groupBy("entity_id").agg(F.min_by("hit", F.struct("pos", "n")).alias("h")).select(
        "entity_id", F.col("h.canonical_name").alias("maps_place"), F.col("h.reviews").alias("maps_review_count"))


# ---- blocked pairs and scores -----------------------------------------------------------------
def token_subset_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs where all tokens of ``left`` occur in ``right``, without meeting every row.

    ``left`` sends one row, under its rarest token; ``right`` one row per token. Both need
    (id, tokens); tokens must be distinct.
    """
    rights = right.select(F.col("id").alias("rid"), F.col("tokens").alias("rtokens"), F.explode("tokens").alias("tok"))
    freq = rights.groupBy("tok").agg(F.count(ONE).alias("df"))
    lefts = left.select("id", "tokens", F.explode("tokens").alias("tok")).join(freq, "tok")
    size = F.size("tokens")
    rare = lefts.groupBy("id").agg(F.min_by(F.struct("tok", "tokens"), F.struct("df", "tok")).alias("m"),
                                   F.count(ONE).alias("known"))
    rare = rare.select("id", F.col("m.tok").alias("tok"), F.col("m.tokens").alias("tokens"), "known").filter(
        F.col("known") == size)
    return rare.join(rights, "tok").filter(F.size(F.array_except("tokens", "rtokens")) == 0).select("id", "rid")


def official_form(a: Column, b: Column) -> Column:
    """One token set is the other plus only kind-of-place words."""
    extra = F.when(F.size(a) < F.size(b), F.array_except(b, a)).otherwise(F.array_except(a, b))
    inside = F.when(F.size(a) < F.size(b), F.size(F.array_except(a, b)) == 0).otherwise(
        F.size(F.array_except(b, a)) == 0)
    words = F.array(*[F.lit(w) for w in vocab.CATEGORY_WORDS])
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) != F.size(b)) & inside & (
        F.size(F.array_except(extra, words)) == 0)


def pair_signals(pairs: DataFrame, embeddings_column: str | None = None) -> DataFrame:
    """Similarity of two surface records and each signal behind it.

    ``pairs`` carries structs ``a`` and ``b`` with normalized, key_tokens, name_tokens,
    bengali, districts and divisions. Signals that cannot apply stay NULL and the weights of
    the others are rescaled. An optional cosine column is averaged in.
    """
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    ka, kb = a("key_tokens"), b("key_tokens")
    a_in_b, b_in_a = F.size(F.array_except(ka, kb)) == 0, F.size(F.array_except(kb, ka)) == 0
    both = (F.size(ka) > 0) & (F.size(kb) > 0)
    phon = F.when(both & a_in_b & b_in_a, 1.0).when(both & (a_in_b | b_in_a), 0.75).otherwise(0.0)
    cross = a("bengali") != b("bengali")
    geo = (
        F.when(F.arrays_overlap(a("districts"), b("districts")), 1.0)
        .when(F.arrays_overlap(a("divisions"), b("divisions")), 0.6)
        .when((F.size(a("districts")) > 0) & (F.size(b("districts")) > 0), -0.5).otherwise(0.0)
    )
    scored = (
        pairs.withColumn("phonetic", phon).withColumn("geography", geo)
        .withColumn("ratio", S.fuzzy_ratio(F.when(~cross, a("normalized")), F.when(~cross, b("normalized"))))
        .withColumn("string", F.when(F.col("ratio") >= vocab.MIN_STRING_RATIO, F.col("ratio") / 100)
                    .when(F.col("ratio").isNotNull(), 0.0))
        .withColumn("containment", F.when(cross, None).when(official_form(a("name_tokens"), b("name_tokens")), 1.0)
                    .otherwise(0.0))
    )
    w = vocab.PAIR_WEIGHTS
    top = sum((F.coalesce(F.col(s) * w[s], F.lit(0.0)) for s in w), F.lit(0.0))
    live = sum((F.when(F.col(s).isNotNull(), F.lit(w[s])).otherwise(0.0) for s in w), F.lit(0.0))
    score = top / live
    if embeddings_column is not None:
        score = F.when(F.col(embeddings_column).isNotNull(), (score + F.col(embeddings_column)) / 2).otherwise(score)
    return scored.withColumn("score", score).drop("ratio")


def _bigram_keys(left: DataFrame, right: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The rare letter pairs of both sides that names with an indel ratio of ``ratio`` (0.7 or more) have one of in common.

    Names of n and m characters at that ratio lose at most (1 - ratio)(n + m) characters, so
    they share at least T = (1 - 1.5 (1 - ratio) - 0.5) (n + m) + 1 of their padded letter
    pairs. Ordering letter pairs from rare to common, two names sharing T of them must meet
    inside their first (size - T + 1), so only those rare ones are joined. Exact: no pair at
    or above the ratio is missed. Both sides need (id, key) with distinct keys.
    """
    slope = 0.5 - 1.5 * (1 - ratio)
    shortest = ratio / (2 - ratio)

    def grams(df: DataFrame, prefix: str) -> DataFrame:
        padded = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
        pieces = F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(padded, i, F.lit(2)))
        # Repeats are numbered, so a shared count is a count of equal (piece, number) values.
        numbered = F.transform(pieces, lambda g, i: F.concat(
            g, F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
        return df.select(F.col("id").alias(f"{prefix}id"), F.length("key").alias("n"), F.explode(numbered).alias("g"))

    gl, gr = grams(left, "l"), grams(right, "r")
    freq = gr.groupBy("g").agg(F.count(ONE).alias("df"))

    def prefix(g: DataFrame, key: str) -> DataFrame:
        need = F.ceil(slope * (F.col("n") + F.ceil(F.col("n") * shortest - 1e-9)) + 1 - 1e-9)
        ranked = g.join(freq, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        w = Window.partitionBy(key).orderBy("df", "g")  # one name's letter pairs
        return ranked.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= F.col("n") + 1 - need + 1).select(
            key, "n", "g")

    return prefix(gl, "lid"), prefix(gr, "rid").withColumnRenamed("n", "m")


def bigram_candidates(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """Pairs that can reach an indel ratio of ``ratio`` (0.7 or more), a superset of those that do (see ``_bigram_keys``)."""
    return _meet(*_bigram_keys(left, right, ratio), ratio)


def _meet(l: DataFrame, r: DataFrame, ratio: float) -> DataFrame:
    shortest = ratio / (2 - ratio)
    fits = (F.col("m") >= F.col("n") * shortest - 1e-9) & (F.col("n") >= F.col("m") * shortest - 1e-9)
    return l.join(r, "g").filter(fits).select("lid", "rid").distinct()


def sparse_candidates(left: DataFrame, right: DataFrame, ratio: float, share: float = 0.02) -> DataFrame | None:
    """``bigram_candidates``, or nothing where the letter pairs would bring together more than ``share`` of all pairs.

    There names are alike as a family (numbered ones), and comparing blocks of them (``closest``) costs less than an index.
    """
    l, r = (cut_lineage(x) for x in _bigram_keys(left, right, ratio))
    per = lambda df, n: df.groupBy("g").agg(F.count(ONE).alias(n))
    met = per(l, "a").join(per(r, "b"), "g").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("n")).first()["n"]  # one number
    return _meet(l, r, ratio) if met <= share * left.count() * right.count() else None


def closest(left: DataFrame, right: DataFrame, least: float, k: int, contained: float | None = None, block: int = vectors.BLOCK) -> DataFrame:
    """(lid, rid, similarity, rank): the ``k`` right names most alike each left name, from ``least`` (0 to 100) on, equal ones by ``rid``.

    Indel ratio, ``contained`` at least where one name holds the other. Every pair is compared, block by block;
    of each pair of blocks only the best ``k`` per left name go on. Both sides hold distinct ``id``.
    """

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names, others = a.column("id").to_pylist(), sorted(b.column("id").to_pylist())
        size, got = np.array([len(x) for x in others], dtype=np.int64), []
        for at, common in lcs_rows(names, others) if others else ():
            name = names[at]
            total = size + len(name)
            ratio = 200.0 * common / np.maximum(total, 1)
            if contained is not None:
                for j in np.flatnonzero((common == np.minimum(size, len(name))) & (ratio < contained)):
                    if name in others[j] or others[j] in name:
                        ratio[j] = contained
            for _ in range(min(k, len(others))):
                j = int(np.argmax(ratio))  # the first, so the lowest name, of equal ones
                if ratio[j] < least:
                    break
                got.append((name, others[j], float(ratio[j])))
                ratio[j] = -1.0
        return pa.table({c: pa.array([x[i] for x in got], t) for i, (c, t) in enumerate((("lid", pa.string()), ("rid", pa.string()), ("similarity", pa.float64())))})

    best = vectors.each_pair_of_blocks(left.select("id"), right.select("id"), meet, "lid string, rid string, similarity double", block, tasks=4096)
    return top_per_key(best, ["lid"], [F.desc("similarity"), F.asc("rid")], k)


def reaching(left: DataFrame, right: DataFrame, least: float, block: int = vectors.BLOCK) -> DataFrame:
    """(lid, rid, ratio) of every pair of names with an indel ratio of ``least`` or more (0 to 100), compared as in ``closest``; both sides hold distinct ``id``."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names, others = a.column("id").to_pylist(), b.column("id").to_pylist()
        size, got = np.array([len(x) for x in others], dtype=np.int64), []
        for at, common in lcs_rows(names, others) if others else ():
            ratio = 200.0 * common / np.maximum(size + len(names[at]), 1)
            got += [(names[at], others[j], float(ratio[j])) for j in np.flatnonzero(ratio >= least)]
        return pa.table({c: pa.array([x[i] for x in got], t) for i, (c, t) in enumerate((("lid", pa.string()), ("rid", pa.string()), ("ratio", pa.float64())))})

    return vectors.each_pair_of_blocks(left.select("id"), right.select("id"), meet, "lid string, rid string, ratio double", block, tasks=4096)


def spelling_proposals(names: DataFrame, listed: DataFrame, decided: DataFrame) -> DataFrame:
    """Best listed place per undecided name when the indel ratio reaches 80.

    ``names`` holds (name), ``listed`` (place), ``decided`` (variant). Names that are listed or
    already decided are left out; copies of one core name are compared once.
    """
    keys = listed.select(T.core_name(F.col("place")).alias("key"), "place").filter("key <> ''").groupBy("key").agg(
        F.min("place").alias("place"))
    known = decided.select(T.core_name(F.col("variant")).alias("key")).distinct()
    ascii_only = ~F.col("name").rlike(r"[^\x{00}-\x{7f}]")
    open_names = (
        names.filter(ascii_only).select(T.core_name(F.col("name")).alias("key"), "name").filter("key <> ''")
        .groupBy("key").agg(F.min("name").alias("name"))
        .join(keys.select("key"), "key", "left_anti").join(known, "key", "left_anti")
    )
    sides = [cut_lineage(x.select(F.col("key").alias("id"), "key")) for x in (open_names, keys)]
    pairs = sparse_candidates(*sides, vocab.SPELLING_MIN_SIMILARITY / 100)
    scored = closest(*sides, vocab.SPELLING_MIN_SIMILARITY, 1).drop("rank") if pairs is None else pairs.withColumn(
        "similarity", S.indel_ratio(F.col("lid"), F.col("rid"))).filter(F.col("similarity") >= vocab.SPELLING_MIN_SIMILARITY)
    best = scored.groupBy(F.col("lid").alias("key")).agg(F.min_by(
        F.struct("rid", "similarity"), F.struct((-F.col("similarity")).alias("s"), "rid")).alias("b"))
    return (
        best.join(open_names, "key")
        .join(keys.select(F.col("key").alias("rid"), "place"), F.col("b.rid") == F.col("rid"))
        .select(F.col("name").alias("variant"), "place", F.bround("b.similarity", 1).alias("similarity"),
                F.lit("pending").alias("decision"), F.lit("").alias("reason"))
    )


def nearby_places(places: DataFrame, metres: float = vocab.NEAR_PAIR_METRES) -> DataFrame:
    """Pairs of listed places at most ``metres`` apart, by grid cell.

    A cell is at least ``metres`` wide in both directions, so a partner lies in the same cell
    or one of the eight around it.
    """
    step = metres / 111_000.0
    lng_step = step / 0.85  # wide enough at the northern edge of the box (cos 26.7 deg = 0.89)
    cols = ["place_id", "name", "lat", "lng", "review_count"]
    p = places.filter("lat IS NOT NULL AND lng IS NOT NULL").select(
        *cols, F.floor(F.col("lat") / step).alias("cy"), F.floor(F.col("lng") / lng_step).alias("cx"))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    right = p.select(*[F.col(c).alias(f"b_{c}") for c in cols + ["cy", "cx"]])
    left = p.withColumn("d", F.explode(around)).select(
        *[F.col(c).alias(f"a_{c}") for c in cols],
        (F.col("cy") + F.col("d.dy")).alias("b_cy"), (F.col("cx") + F.col("d.dx")).alias("b_cx"))
    near = left.join(right, ["b_cy", "b_cx"]).filter("a_place_id < b_place_id")
    m = S.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return near.withColumn("metres", m).filter(F.col("metres") <= metres).drop("b_cy", "b_cx")


def close_duplicates(places: DataFrame) -> DataFrame:
    """Close pairs judged: the same place listed twice, or near but different.

    Copies of one name at one point merge into the most reviewed copy directly; only one row
    per distinct (point, name) is compared with its neighbours.
    """
    keyed = places.withColumn("nk", T.norm_name(F.col("name")))
    best = F.struct((-F.col("review_count")).alias("r"), F.col("place_id"))
    cols = ["place_id", "name", "lat", "lng", "review_count"]
    reps = keyed.groupBy("lat", "lng", "nk").agg(F.min_by(F.struct(*cols), best).alias("k"), F.count(ONE).alias("n"))
    copied = keyed.join(reps.filter("n > 1").select("lat", "lng", "nk", "k"), ["lat", "lng", "nk"]).filter(
        F.col("place_id") != F.col("k.place_id")).select(
        F.col("k.place_id").alias("a_place_id"), F.col("place_id").alias("b_place_id"),
        F.col("k.name").alias("a_name"), F.col("name").alias("b_name"), F.lit(0.0).alias("metres"),
        F.lit(1.0).alias("similarity"), F.lit("merge").alias("outcome"), F.col("k.place_id").alias("kept_place_id"))
    near = nearby_places(reps.select("k.*"))
    na, nb = T.norm_name(F.col("a_name")), T.norm_name(F.col("b_name"))
    inside = (na != "") & (nb != "") & (F.contains(na, nb) | F.contains(nb, na))
    ratio = S.indel_ratio(na, nb) / 100
    alike = F.when((na == "") | (nb == ""), 0.0).when(inside, F.greatest(ratio, F.lit(0.85))).otherwise(ratio)
    judged = near.withColumn("similarity", alike)
    same = (F.col("metres") <= vocab.SAME_PLACE_METRES) & (F.col("similarity") >= vocab.NAME_SUGGEST)
    keep_a = F.col("a_review_count") >= F.col("b_review_count")
    return judged.select(
        "a_place_id", "b_place_id", "a_name", "b_name", F.bround("metres", 0).alias("metres"),
        F.bround("similarity", 2).alias("similarity"),
        F.when(same, "merge").otherwise("near").alias("outcome"),
        F.when(same, F.when(keep_a, F.col("a_place_id")).otherwise(F.col("b_place_id"))).alias("kept_place_id")
    ).unionByName(copied)


# ---- original and translation ---------------------------------------------------------------
def translation_pairs(reviews: DataFrame) -> DataFrame:
    """Reviews given in two versions, by the script of the original."""
    both = reviews.filter(
        F.col("review_text_original").isNotNull() & (F.col("original_language") == "bn")
        & (T.strip(F.col("review_text_original")) != T.strip(F.col("review_text_clean"))))
    bn, la = script_shares(F.col("review_text_original"))
    return both.withColumn("script", F.when(bn > 0.8, "bangla").when(la > 0.8, "banglish")).filter("script IS NOT NULL")


def translation_compare(original: DataFrame, translation: DataFrame, translated_words: DataFrame) -> DataFrame:
    """Concepts of both versions side by side: kept, lost or only in the translation.

    ``original`` and ``translation`` hold (review_id, entity_type, concept, surface, secondary);
    ``translated_words`` (review_id, words). A lost place whose name nearly occurs in the
    translation counts as respelled.
    """
    o = original.groupBy("review_id", "entity_type", "concept").agg(
        F.min("surface").alias("original_surface"), F.bool_or("secondary").alias("os"))
    t = translation.groupBy("review_id", "entity_type", "concept").agg(
        F.min("surface").alias("translation_surface"), F.bool_or("secondary").alias("ts"))
    j = o.join(t, ["review_id", "entity_type", "concept"], "full_outer")
    lost = j.filter("translation_surface IS NULL AND entity_type = 'PLACE'").select("review_id", "concept").join(
        translated_words, "review_id")
    size = F.size(F.split("concept", " "))
    windows = F.explode_outer(F.filter(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))),
        lambda i: F.array_join(F.slice("words", i, size), " ")), lambda w: w != ""))
    near = (
        lost.select("review_id", "concept", windows.alias("w"))
        .withColumn("r", S.indel_ratio(F.lower("concept"), F.col("w")))
        .groupBy("review_id", "concept").agg(F.max("r").alias("best"))
        .filter(F.col("best") >= vocab.RESPELLED_SIMILARITY).select(
            "review_id", "concept", F.lit("PLACE").alias("entity_type"), F.lit(True).alias("respelled"))
    )
    return j.join(near, ["review_id", "entity_type", "concept"], "left").select(
        "review_id", "entity_type", "concept",
        F.col("original_surface").isNotNull().alias("in_original"),
        F.col("translation_surface").isNotNull().alias("in_translation"),
        F.when(F.col("original_surface").isNotNull() & F.col("translation_surface").isNotNull(), "kept")
        .when(F.col("original_surface").isNull(), "only_in_translation")
        .when(F.col("respelled"), "lost_respelled").otherwise("lost_translated_or_dropped").alias("outcome"),
        (~(F.coalesce("os", F.lit(False)) | F.coalesce("ts", F.lit(False)))).alias("own_place"),
        F.coalesce("original_surface", F.lit("")).alias("original_surface"),
        F.coalesce("translation_surface", F.lit("")).alias("translation_surface"))
