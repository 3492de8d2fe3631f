"""Visibility, the explainable score of little-known places, and the decision queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import script_shares
from roamlens.functions.similarity import half_even
from roamlens.operators.joins import recent_bound
from roamlens.session import broadcast_if_measured, broadcast_if_small, first_per_key

ONE = "*"  # counted rows
TERMS = list(vocab.GEM_WEIGHTS)


# ---- visibility ----------------------------------------------------------------------------
def visibility(lookups: DataFrame) -> DataFrame:
    """Level and reason from two lookup tables; unknown when a needed source was not reached."""
    osm, wd = F.col("osm_status") == "ok", F.col("wikidata_status") == "ok"
    imp = F.coalesce("osm_importance", F.lit(0.0))
    links = F.coalesce("wikidata_sitelinks", F.lit(-1))
    on_osm, on_wd = F.coalesce("osm_found", F.lit(False)), F.coalesce("wikidata_found", F.lit(False))
    level = (
        F.when(~osm & ~wd, "unknown").when((links >= vocab.V3_SITELINKS) | (imp >= vocab.V3_IMPORTANCE), "V3")
        .when((links >= vocab.V2_SITELINKS) | (imp >= vocab.V2_IMPORTANCE), "V2").when(on_osm | on_wd, "V1")
        .when(osm & wd, "V0").otherwise("unknown"))
    reason = (
        F.when(~osm & ~wd, "neither source could be reached")
        .when(F.col("visibility") == "V3", F.concat(F.lit("well documented: "), links, F.lit(" sitelink(s)")))
        .when(F.col("visibility") == "V2", F.concat(F.lit("moderately documented: "), links, F.lit(" sitelink(s)")))
        .when(F.col("visibility") == "V1", F.when(on_osm, "on the map but barely documented").otherwise("in the knowledge base but barely documented"))
        .when(F.col("visibility") == "V0", "absent from both sources").otherwise("absent from one source, the other was unreachable"))
    return lookups.withColumn("visibility", level).withColumn("visibility_reason", reason)


def raise_by_list(visible: DataFrame) -> DataFrame:
    """The place-list level when it is higher; an unknown level always gives way to it."""
    n = F.col("maps_review_count")
    maps = F.when(F.col("maps_place").isNotNull(), F.when(n >= vocab.MAPS_V3_REVIEWS, "V3").when(n >= vocab.MAPS_V2_REVIEWS, "V2").otherwise("V1"))
    take = maps.isNotNull() & ((F.col("visibility") == "unknown") | (maps > F.col("visibility")))
    reason = F.concat(F.lit("on the place list as "), F.col("maps_place"), F.when(n.isNull(), " (review count not recorded)").otherwise(
        F.concat(F.lit(" with "), n, F.lit(" review(s)"))))
    return visible.withColumn("take", take).withColumn("visibility_reason", F.when(F.col("take"), reason).otherwise(F.col("visibility_reason"))).withColumn(
        "visibility", F.when(F.col("take"), maps).otherwise(F.col("visibility"))).drop("take")


# ---- candidates and terms -------------------------------------------------------------------
def candidates(entities: DataFrame, pairs: DataFrame, min_reviews: int = vocab.MIN_INDEPENDENT_MENTIONS) -> DataFrame:
    """Place entities mentioned in enough distinct reviews, from (entity, review) pairs."""
    g = pairs.groupBy("entity_id").agg(F.sum("m").alias("n_mentions"), F.count(ONE).alias("n_reviews")).filter(
        F.col("n_reviews") >= min_reviews)
    return entities.filter("entity_type = 'PLACE'").select("entity_id", "canonical_name", "entity_type").join(g, "entity_id")


def entity_reviews(mentions: DataFrame) -> DataFrame:
    """One row per (entity, review); every term that counts reviews starts here."""
    return mentions.filter("entity_id IS NOT NULL").groupBy("entity_id", "review_id").agg(F.count(ONE).alias("m"))


def term_mentions(n_reviews: Column) -> Column:
    return F.least(F.lit(1.0), n_reviews / vocab.MENTIONS_SATURATION)


def term_hidden(level: Column) -> Column:
    """Inverse visibility; unknown stays NULL, never zero."""
    known = F.create_map(*[F.lit(x) for kv in vocab.HIDDEN_BY_VISIBILITY.items() for x in kv])
    return F.try_element_at(known, level)


def term_recency(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Share of an entity's dated reviews inside the window, with its sources and years."""
    since = recent_bound(reviews)
    j = pairs.join(reviews.select("review_id", "review_date", "source"), "review_id")
    return j.groupBy("entity_id").agg(
        F.avg(F.when(F.col("review_date").isNotNull(), (F.col("review_date") >= since).cast("double"))).alias("term_recency"),
        F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("n_sources"),
        F.count_distinct(F.year("review_date")).alias("n_years"))


def term_sentiment(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean sentence tone over Latin-script sentences, scaled to 0..1.

    A sentence's tone is x / sqrt(x * x + 15) for the summed weights x of its words. Equal
    sentences of one entity are scored once and weighted by how often they occur; a sentence
    is sent to one task, looked at once, and meets the weights there.
    """
    said = mentions.filter("entity_id IS NOT NULL").groupBy("entity_id", "sentence").agg(F.count(ONE).alias("times"))
    part = F.transform(F.array(T.strip(F.coalesce("sentence", F.lit("")))), lambda s: F.when(
        (s != "") & (script_shares(s)[1] >= vocab.LATIN_SENTENCE_SHARE), F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}']+"), F.lit(0))))[0]
    words = said.select("entity_id", "sentence", "times", F.explode(F.array(part)).alias("ws")).filter("ws IS NOT NULL").select(
        "entity_id", "sentence", "times", F.explode_outer("ws").alias("w"))
    known = broadcast_if_measured(lexicon.select(F.col("word").alias("w"), "weight"))
    x = words.join(known, "w", "left").groupBy("entity_id", "sentence", "times").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("x"))
    tone = x.withColumn("c", F.col("x") / F.sqrt(F.col("x") * F.col("x") + 15))
    return tone.groupBy("entity_id").agg(
        ((F.sum(F.col("c") * F.col("times")) / F.sum("times") + 1) / 2).alias("term_sentiment"), F.sum("times").alias("n_sentiment_sentences"))


def _words(text: Column, stop_words: list[str]) -> Column:
    stop = F.array(*[F.lit(s) for s in stop_words])
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"[{T.WORD_CHARS}]{{2,}}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def _raw_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    return counts.join(idf, "term").withColumn("w", (1 + F.ln("c")) * F.col("idf")).drop("c", "idf")


def _marked(docs: DataFrame, ids: DataFrame, column: str, mark: str) -> DataFrame:
    """Rows whose id is in the (hashed) ids are marked; an equal hash only sends a document the longer way."""
    return docs.join(ids.withColumnRenamed("h", f"_{mark}"), F.xxhash64(F.col(column).cast("string")) == F.col(f"_{mark}"), "left").withColumn(
        mark, F.col(f"_{mark}").isNotNull()).drop(f"_{mark}")


def term_distinct(mentions: DataFrame, reviews: DataFrame, stop_words: list[str]) -> DataFrame:
    """Mean of 1 - cosine between a mention's sentence and the centre of its host place.

    ``reviews``: review_id, place_name, review_text; ``mentions``: mention_id, entity_id, review_id, sentence. Both are weighed
    as one corpus by unit-length TF-IDF: tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1, words of two or more characters.

    A mention is sent to its review and then to the rows of its entity, place and sentence; equal ones are weighed once, and its words
    are counted, weighed and compared where it lies. A place's centre is summed per (place, term). Rows that share an id
    are one document; only these are gathered by id.
    """
    again = lambda df, c: broadcast_if_measured(df.groupBy(F.xxhash64(F.col(c).cast("string")).alias("h")).agg(F.count(ONE).alias("n")).filter("n > 1").select("h"))
    r_again, m_again = again(reviews, "review_id"), again(mentions, "mention_id")
    r = _marked(reviews.select(F.concat(F.lit("r"), F.col("review_id").cast("string")).alias("doc"), "review_id", "place_name",
                               F.col("review_text").alias("text")), r_again, "review_id", "odd")
    m = _marked(_marked(mentions.select(F.concat(F.lit("m"), "mention_id").alias("doc"), "entity_id", "review_id", F.col("sentence").alias("text"), "mention_id"),
                        m_again, "mention_id", "m_odd"), r_again, "review_id", "r_odd").withColumn("odd", F.col("m_odd") | F.col("r_odd")).drop("mention_id", "m_odd", "r_odd")
    odd = lambda df: df.filter(F.col("odd") | F.col("doc").isNull())
    plain = lambda df: df.filter(~F.col("odd") & F.col("doc").isNotNull())
    words = lambda df, *keys: df.select(*keys, F.explode(_words(F.col("text"), stop_words)).alias("term"))

    size_of = lambda df, c: df.agg(F.count(ONE).alias("n"), F.count_if(F.col(c).isNull()).alias("blank")).first()
    rows = [size_of(reviews, "review_id"), size_of(mentions, "mention_id")]  # two numbers each
    n, all_plain = sum(x.n for x in rows), not any(x.blank for x in rows) and r_again.isEmpty() and m_again.isEmpty()

    # document frequencies over both kinds; rows of one id count once
    shared = words(odd(r), "doc").unionByName(words(odd(m), "doc"))
    alone = plain(r).select("text").unionByName(plain(m).select("text")).groupBy("text").agg(F.count(ONE).alias("k"))  # equal texts are cut once
    held = alone.select("k", F.explode(F.array_distinct(_words(F.col("text"), stop_words))).alias("term"))
    if not all_plain:
        held = held.unionByName(shared.distinct().select(F.lit(1).cast("long").alias("k"), "term"))
    df = held.groupBy("term").agg(F.sum("k").alias("df"))
    idf = broadcast_if_measured(df.select("term", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))

    # documents of shared ids: weights by id
    raw = _raw_weights(shared.groupBy("doc", "term").agg(F.count(ONE).alias("c")), idf)
    w = raw.join(raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))

    # centres
    text = ["place_name", "text"]
    hosts = plain(r).groupBy(*text).agg(F.count(ONE).alias("k"))
    said = _raw_weights(words(hosts, *text, "k").groupBy(*text, "k", "term").agg(F.count(ONE).alias("c")), idf)
    unit = said.groupBy(*text, "k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("ws"))
    unit = unit.select("place_name", "k", "norm", F.inline("ws")).select("place_name", "term", (F.col("k") * F.col("w") / F.col("norm")).alias("w"))
    if not all_plain:
        unit = unit.unionByName(odd(r).select("doc", "place_name").join(w, "doc").select("place_name", "term", "w"))
    centre = broadcast_if_measured(unit.filter("place_name IS NOT NULL").groupBy("place_name", "term").agg(F.sum("w").alias("cw")))
    size = reviews.groupBy("place_name").agg(F.count(ONE).alias("n_rows"))
    length = broadcast_if_measured(centre.join(size, "place_name").groupBy("place_name").agg(
        F.sqrt(F.sum(F.pow(F.col("cw") / F.col("n_rows"), 2))).alias("clen"), F.first("n_rows").alias("n_rows")))
    far = lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(d / F.col("n_rows") / F.col("clen"), F.lit(0.0))))

    # mentions with an id and a review of their own
    keys = ["entity_id", "place_name", "text"]
    one = plain(m).filter("trim(text) <> ''").join(plain(r).select("review_id", "place_name"), "review_id").groupBy(*keys).agg(F.count(ONE).alias("k"))
    terms = one.select(*keys, "k", F.explode_outer(_words(F.col("text"), stop_words)).alias("term")).groupBy(*keys, "k", "term").agg(F.count(ONE).alias("c"))
    x = terms.join(idf, "term", "left").withColumn("w", (1 + F.ln("c")) * F.col("idf")).join(centre, ["place_name", "term"], "left")
    dots = x.groupBy(*keys, "k").agg((F.sum(F.col("w") * F.col("cw")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("d"))
    v = dots.join(length, "place_name").select("entity_id", (far(F.col("d")) * F.col("k")).alias("v"), "k")

    if not all_plain:  # the rest, gathered by id
        o = odd(m).filter("trim(text) <> ''").select("doc", "entity_id", "review_id").join(r.select("review_id", "place_name"), "review_id")
        d = o.select("doc", "place_name").join(w, "doc").join(centre, ["place_name", "term"]).groupBy("doc").agg(F.sum(F.col("w") * F.col("cw")).alias("d"))
        v = v.unionByName(o.join(length, "place_name").join(d, "doc", "left").select("entity_id", far(F.col("d")).alias("v"), F.lit(1).cast("long").alias("k")))
    return v.groupBy("entity_id").agg((F.sum("v") / F.sum("k")).alias("term_distinct"))


# ---- score ---------------------------------------------------------------------------------------
def weighted_score(ablate: set[str] = frozenset()) -> Column:
    """Score over the terms that are kept and present, weights rescaled to one."""
    live = [t for t in TERMS if t not in ablate]
    if not live:
        raise ValueError("every term was ablated; nothing left to score with")
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    top = add([F.coalesce(F.col(f"term_{t}") * vocab.GEM_WEIGHTS[t], F.lit(0.0)) for t in live])
    weight = add([F.when(F.col(f"term_{t}").isNotNull(), F.lit(vocab.GEM_WEIGHTS[t])).otherwise(0.0) for t in live])
    return F.try_divide(top, weight)


def score(cands: DataFrame, visible: DataFrame, recency: DataFrame, sentiment: DataFrame, distinct: DataFrame,
          ablate: set[str] = frozenset()) -> DataFrame:
    """All terms and the score of every candidate."""
    v = visible.select("entity_id", "visibility")
    j = (
        cands.join(broadcast_if_small(v), "entity_id", "left").join(recency, "entity_id", "left")
        .join(sentiment, "entity_id", "left").join(distinct, "entity_id", "left")
        .withColumn("visibility", F.coalesce("visibility", F.lit("unknown")))
        .withColumn("term_mentions", term_mentions(F.col("n_reviews"))).withColumn("term_hidden", term_hidden(F.col("visibility"))))
    used = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"term_{t}").isNotNull(), F.lit(t)) for t in TERMS if t not in ablate])))
    return j.withColumn("raw", weighted_score(ablate)).select(
        "entity_id", "canonical_name", "entity_type", half_even(F.col("raw"), 4).alias("gem_score"), "n_reviews", "n_mentions",
        "n_sources", "n_years", "visibility", (F.col("visibility") == "V3").alias("already_official"),
        *[half_even(F.col(f"term_{t}"), 4).alias(f"term_{t}") for t in TERMS], F.array_join(used, "|").alias("terms_used"),
        F.coalesce("n_sentiment_sentences", F.lit(0)).alias("n_sentiment_sentences"))


def ablations(scored: DataFrame) -> DataFrame:
    """Score of every candidate without each term, beside the full score."""
    options = [("none", set())] + [(t, {t}) for t in TERMS]
    return scored.select("entity_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("ablated"), half_even(weighted_score(a), 4).alias("gem_score")) for n, a in options])).alias("x")).select(
        "entity_id", "x.ablated", "x.gem_score")


def term_spread(scored: DataFrame) -> DataFrame:
    """Terms that are constant or nearly so, over at least three candidates."""
    long = scored.unpivot(["entity_id"], [f"term_{t}" for t in TERMS], "term", "value").filter("value IS NOT NULL")
    g = long.groupBy("term").agg(F.count(ONE).alias("n"), F.count_distinct("value").alias("n_values"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return g.withColumn("note", F.when(F.col("n") < 3, "too few").when(F.col("n_values") == 1, "constant")
                        .when(F.col("sd") < 0.05, "little spread").otherwise("ok"))


def outranked(scored: DataFrame) -> DataFrame:
    """How many other candidates the best already official one outranks."""
    best = scored.filter("already_official").agg(F.max("gem_score").alias("b")).scalar()
    return scored.agg(
        F.count_if("already_official").alias("n_official"), F.max(F.when(F.col("already_official"), F.col("gem_score"))).alias("best_official"),
        F.count_if(~F.col("already_official") & (F.col("gem_score") < best)).alias("n_outranked"))


# ---- decisions -------------------------------------------------------------------------------------
def current_states(log: DataFrame) -> DataFrame:
    """Latest decision per entity; on one time the later log row. The log itself stays."""
    latest = F.struct(F.col("decided_at_utc"), F.col("log_order"))
    cols = ["entity_id", "state", "decided_by", "decided_at_utc", "reason"]
    return log.groupBy("entity_id").agg(F.max_by(F.struct(*cols[1:]), latest).alias("d")).select("entity_id", *[f"d.{c}" for c in cols[1:]])


def validate_decisions(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """Each proposed decision with 'accepted' or why it would not be auditable."""
    state = F.lower(T.strip(F.coalesce("state", F.lit(""))))
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    outcome = (
        F.when(~state.isin(vocab.VERIFICATION_STATES), "unknown state").when(state == "candidate", "not a decision")
        .when(blank("decided_by"), "no author").when(blank("reason"), "no reason").when(F.col("known").isNull(), "unknown entity").otherwise("accepted"))
    return decisions.join(broadcast_if_small(known.select("entity_id", F.lit(True).alias("known")).distinct()), "entity_id", "left").withColumn(
        "state", state).withColumn("outcome", outcome).drop("known")


def queue(scored: DataFrame, states: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every candidate with its state, evidence count, divisions and first evidence."""
    ev = evidence.groupBy("entity_id").agg(
        F.count(ONE).alias("n_evidence"), F.array_join(F.array_sort(F.collect_set("found_in_division")), "|").alias("divisions"),
        F.min_by(F.struct("sentence", "found_in_place"), "mention_id").alias("e"))
    state = F.coalesce("state", F.lit("candidate"))
    return scored.select("entity_id", "canonical_name", "entity_type", "gem_score", "visibility", "n_reviews", "n_mentions").join(
        states, "entity_id", "left").join(ev, "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_type", "gem_score", "visibility", "n_reviews", "n_mentions", state.alias("state"),
        (state == "verified").alias("publishable"), "decided_by", "decided_at_utc", "reason", F.coalesce("divisions", F.lit("")).alias("divisions"),
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("e.sentence", F.lit("")).alias("example_evidence"),
        F.coalesce("e.found_in_place", F.lit("")).alias("example_found_in"))


def queue_order() -> list[Column]:
    """Undecided first, then by score."""
    return [F.desc(F.col("state") == "candidate"), F.desc_nulls_last("gem_score"), F.asc("entity_id")]


def register(queue_rows: DataFrame) -> DataFrame:
    """Everything but rejected; sensitive items stay in."""
    return queue_rows.filter("state <> 'rejected'")


def publishable(queue_rows: DataFrame) -> DataFrame:
    return queue_rows.filter("state = 'verified'")


# ---- freshness -----------------------------------------------------------------------------------
def freshness(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    since = recent_bound(reviews)
    j = pairs.join(reviews.select("review_id", "review_date"), "review_id")
    return j.groupBy("entity_id").agg(
        F.min("review_date").alias("first_evidence_date"), F.max("review_date").alias("last_evidence_date"),
        F.year(F.max("review_date")).alias("last_evidence_year"),
        F.count_if(F.col("review_date") >= since).alias("n_recent_reviews")).withColumn("recent_since", since)


def with_freshness(gems: DataFrame, fresh: DataFrame) -> DataFrame:
    n = F.coalesce("n_recent_reviews", F.lit(0))
    return gems.join(fresh, "entity_id", "left").withColumn("n_recent_reviews", n).withColumn(
        "freshness", F.when(F.col("n_recent_reviews") > 0, "recent").otherwise("old")).withColumn(
        "needs_recent_confirmation", (F.col("n_recent_reviews") == 0).cast("int"))
