"""Finding named things in review texts, and proving each one against its text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.language import BENGALI, normalize_bangla, phonetic_key
from roamlens.session import broadcast_if_measured, broadcast_if_small

ONE = "*"  # counted rows
TOKEN = f"[{T.WORD_CHARS}]+"


# ---- name lists ------------------------------------------------------------------------------
def gazetteer(names: DataFrame, column: str = "place_name") -> DataFrame:
    """Usable names: as given and unqualified, without article, four letters, not generic."""
    forms = F.explode(F.array(T.strip_article(T.strip(F.col(column))), T.strip_article(T.strip_qualifier(F.col(column)))))
    return names.select(forms.alias("name")).distinct().filter((F.length("name") >= 4) & ~T.is_generic(F.col("name")))


def drop_generic(mentions: DataFrame) -> DataFrame:
    return mentions.filter(~T.is_generic(F.col("surface")))


# ---- dictionary match ---------------------------------------------------------------------------
def match_positions(texts: DataFrame, pattern: str) -> DataFrame:
    """(review_id, pos, token, start, end) of every match, with 0-based character offsets.

    Matches and the gaps between them are taken in one pass; offsets are a running sum over
    one text, counted in characters.
    """
    words = F.regexp_extract_all("review_text", F.lit(pattern), F.lit(0))
    gaps = F.split("review_text", pattern)
    # Zipped once per text; an array looked up inside a lambda would be rebuilt per word.
    cut = texts.select("review_id", F.posexplode(F.arrays_zip(words.alias("w"), gaps.alias("g"))).alias("pos", "z")).filter("z.w IS NOT NULL").select(
        "review_id", "pos", F.struct(F.col("z.w").alias("w"), F.length("z.g").alias("g"), F.length("z.w").alias("n")).alias("t"))
    w = Window.partitionBy("review_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one text
    end = F.sum(F.col("t.g") + F.col("t.n")).over(w).cast("int")
    return cut.withColumn("end", end).select(
        "review_id", "pos", F.col("t.w").alias("token"), (F.col("end") - F.col("t.n")).cast("int").alias("start"), "end")


def _endings(token: Column) -> Column:
    """Forms a closing word may stand for: itself, without plural, without a Bangla ending."""
    plural = F.array(token, F.regexp_replace(token, "s$", ""), F.regexp_replace(token, "es$", ""))
    suffixes = F.array(*[F.lit(s) for s in vocab.BANGLA_SUFFIXES])
    cut = F.transform(F.filter(suffixes, lambda s: F.endswith(token, s)), lambda s: F.left(token, F.length(token) - F.length(s)))
    forms = F.when(token.rlike(BENGALI), F.concat(F.array(token), cut)).otherwise(plural)
    return F.filter(F.array_distinct(forms), lambda f: f != "")


def term_spans(texts: DataFrame, terms: DataFrame, plurals: bool) -> DataFrame:
    """Every whole-word occurrence of every term: (review_id, term_id, start, end).

    A term is cut into the same words as the texts. Each text sends its word runs of the
    lengths in use, and only runs equal to a term's words are checked against the text, so
    the work is linear in the texts. ``plurals`` also accepts an ending on the last word.
    """
    clean = F.when(F.col("term").rlike(BENGALI), normalize_bangla(F.col("term"))).otherwise(F.col("term"))
    t = terms.withColumn("term", clean).withColumn("words", F.regexp_extract_all(F.lower("term"), F.lit(TOKEN), F.lit(0)))
    t = broadcast_if_measured(t.filter(F.size("words") > 0).select(
        "term_id", "term", F.size("words").alias("size"), F.array_join("words", " ").alias("key"),
        F.length(F.regexp_extract("term", f"^[^{T.WORD_CHARS}]*", 0)).alias("lead"), F.length("term").alias("len")))
    longest = t.agg(F.max("size")).first()[0] or 1  # one number
    w = Window.partitionBy("review_id").orderBy("pos")  # one text
    ahead = F.array_compact(F.array(*[F.lead(F.lower("token"), j).over(w) for j in range(longest)]))
    runs = match_positions(texts, TOKEN).select("review_id", "start", ahead.alias("ahead"))
    grams = runs.withColumn("size", F.explode(F.sequence(F.lit(1), F.size("ahead"))))
    grams = grams.join(F.broadcast(t.select("size").distinct()), "size", "left_semi")
    last = F.element_at("ahead", F.col("size"))
    forms = _endings(last) if plurals else F.when(last.rlike(BENGALI), _endings(last)).otherwise(F.array(last))
    head = F.slice("ahead", F.lit(1), F.col("size") - 1)
    key = F.array_join(F.concat(head, F.array("form")), " ")
    grams = grams.withColumn("form", F.explode(forms)).select("review_id", "start", "size", key.alias("key"))
    hits = grams.join(t, ["size", "key"])
    body = texts.select("review_id", F.col("review_text").alias("body"))
    at = hits.withColumn("s", F.col("start") - F.col("lead")).withColumn("e", F.col("s") + F.col("len"))
    checked = at.join(body, "review_id").filter(
        (F.col("s") >= 0) & (F.lower(F.substring("body", F.col("s") + 1, F.col("len"))) == F.lower("term")))
    # Word runs already end at word boundaries; only terms with punctuation at an end need a look.
    edge = f"[{T.WORD_CHARS}]"
    before = F.when(F.col("s") > 0, F.substring("body", F.col("s"), F.lit(1))).otherwise("")
    after = F.substring("body", F.col("e") + 1, F.lit(1))
    free = F.col("term").rlike("^" + edge) | ~before.rlike(edge)
    closed = F.col("term").rlike(edge + "$") | ~after.rlike(edge)
    return checked.filter(free & closed).select(
        "review_id", "term_id", "term", F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"),
        F.substring("body", F.col("s") + 1, F.col("len")).alias("surface")).distinct()


def place_mentions(texts: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Known places named in a text, except its own place; the longest name keeps the span.

    A name is skipped where an earlier name in (longest, A-Z) order covers it. Covering is
    transitive, so a span survives exactly when no other candidate covers it: one running
    maximum over a text's spans decides, with no sequential claim list.
    """
    listed = names.select("name", F.col("name").alias("stands_for"))
    if aliases is not None:
        listed = listed.unionByName(aliases.select(F.col("bangla").alias("name"), F.col("place").alias("stands_for")))
    terms = listed.groupBy("name").agg(F.max("stands_for").alias("stands_for"))
    spans = term_spans(texts, terms.select(F.col("name").alias("term_id"), F.col("name").alias("term")), plurals=False)
    own = texts.select("review_id", T.name_tokens(F.col("place_name")).alias("own"))
    kept = (
        spans.join(broadcast_if_small(terms.withColumnRenamed("name", "term_id")), "term_id").join(own, "review_id")
        .filter(F.size(F.array_except(T.name_tokens(F.col("stands_for")), "own")) > 0))
    once = kept.groupBy("review_id", "start", "end").agg(
        F.min(F.struct("term_id", "surface", "stands_for")).alias("m"))
    w = Window.partitionBy("review_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # one text
    return once.withColumn("reach", F.max("end").over(w)).filter("reach IS NULL OR reach < end").select(
        "review_id", F.lit("PLACE").alias("entity_type"), "m.surface", "start", "end", F.col("m.stands_for").alias("name"))


_CLAIM = "array<struct<start:int,end:int,surface:string,entity_type:string,name:string>>"


def lexicon_mentions(texts: DataFrame, lexicon: DataFrame, places: DataFrame) -> DataFrame:
    """Foods, activities and transport outside place spans; longer terms claim first.

    Terms overlapping a place are dropped by a running maximum. What is left splits into
    islands of overlapping spans, each a few words long, and only inside an island are spans
    claimed in order.
    """
    terms = lexicon.groupBy("surface", "entity_type").agg(F.min("concept").alias("concept"))
    keyed = terms.select(F.concat_ws("\u0001", "entity_type", "surface").alias("term_id"), F.col("surface").alias("term"), "entity_type", "concept")
    spans = term_spans(texts, keyed.select("term_id", "term"), plurals=True).join(
        broadcast_if_small(keyed.select("term_id", "entity_type", "concept")), "term_id")
    w = Window.partitionBy("review_id").orderBy("start", F.desc("end"), F.desc("p"))  # one text
    both = spans.select("review_id", "start", "end", "surface", "entity_type", F.col("concept").alias("name"), F.lit(0).alias("p")).unionByName(
        places.select("review_id", "start", "end", "surface", "entity_type", "name", F.lit(1).alias("p")))
    prior = F.max(F.when(F.col("p") == 1, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("review_id").orderBy(F.desc("start"), F.asc("end"), F.asc("p")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(F.col("p") == 1, F.col("start"))).over(back)
    free = both.withColumn("prior", prior).withColumn("later", later).filter(
        "p = 0 AND (prior IS NULL OR prior <= start) AND (later IS NULL OR later >= end)")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = free.withColumn("opens", (seen.isNull() | (seen <= F.col("start"))).cast("int")).withColumn(
        "island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = island.groupBy("review_id", "island").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("start") - F.col("end")).alias("k"), "surface", "start", "end", "entity_type", "name"))).alias("c"))
    claim = F.aggregate(
        "c", F.lit(None).cast(_CLAIM),
        lambda acc, x: F.when(
            F.exists(F.coalesce(acc, F.array().cast(_CLAIM)), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc
        ).otherwise(F.concat(F.coalesce(acc, F.array().cast(_CLAIM)), F.array(F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["surface"].alias("surface"),
            x["entity_type"].alias("entity_type"), x["name"].alias("name")).cast("struct<start:int,end:int,surface:string,entity_type:string,name:string>")))))
    return packed.select("review_id", F.explode(claim).alias("m")).select(
        "review_id", "m.entity_type", "m.surface", "m.start", "m.end", "m.name")


def cue_mentions(texts: DataFrame) -> DataFrame:
    """Access and tip phrases, cut back to the last whole word."""
    out = None
    for kind, patterns in (("ACCESS", vocab.ACCESS_CUES), ("TIP", vocab.TIP_CUES)):
        for pattern in patterns:
            java = "(?iU)" + pattern
            found = match_positions(texts.filter(F.col("review_text").rlike(java)), java).withColumn("entity_type", F.lit(kind))
            out = found if out is None else out.unionByName(found)
    body = texts.select("review_id", "review_text")
    letter = r"[\p{L}\p{N}]"
    after = F.substring("review_text", F.col("end") + 1, F.lit(1))
    whole = F.when(after.rlike(letter), F.regexp_replace("token", letter + "+$", "")).otherwise(F.col("token"))
    surface = F.regexp_replace(whole, "^[ .,;:!?-]+|[ .,;:!?-]+$", "")
    lead = F.length(F.regexp_extract("token", "^[ .,;:!?-]*", 0))
    return out.join(body, "review_id").select(
        "review_id", "entity_type", surface.alias("surface"), (F.col("start") + lead).alias("start")).filter("surface <> ''").withColumn(
        "end", F.col("start") + F.length("surface")).withColumn("name", F.col("surface"))


# ---- grounding ---------------------------------------------------------------------------------
@F.pandas_udf(StructType([StructField("at", IntegerType()), StructField("len", IntegerType())]))
def _normalized_find(text: pd.Series, surface: pd.Series, resume: pd.Series, nth: pd.Series) -> pd.DataFrame:
    """The nth span from ``resume`` on whose composed, squeezed form equals the surface's.

    The text is normalised once with a map back to its own offsets, then searched.
    """
    pairs = {a: b for a, b in vocab.BENGALI_COMPOSE}

    def one(t, s, r, nth):
        if t is None or s is None:
            return (None, None)
        form, where, i = [], [], int(r)
        decomposed = [(c, k) for k, ch in enumerate(t[i:], i) for c in unicodedata.normalize("NFD", ch)]
        for ch, k in decomposed:
            if ch in vocab.INVISIBLE_CHARS:
                continue
            if form and form[-1] + ch in pairs:
                form[-1] = pairs[form[-1] + ch]
            elif ch.isspace():
                if form and form[-1] != " ":
                    form.append(" ")
                    where.append((k, k + 1))
                continue
            else:
                form.append(ch)
                where.append((k, k + 1))
                continue
            where[-1] = (where[-1][0], k + 1)
        target = "".join(form)
        want = s
        for a, b in vocab.BENGALI_COMPOSE:
            want = want.replace(a, b)
        at = -len(want)
        for _ in range(int(nth)):
            at = target.find(want, at + len(want))
            if at < 0:
                return (None, None)
        start, end = where[at][0], where[at + len(want) - 1][1]
        return (start, end - start)

    rows = [one(*row) for row in zip(text, surface, resume, nth)]
    return pd.DataFrame(rows, columns=["at", "len"]).astype("Int32")


def ground(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the span that proves them, or the reason they are dropped.

    ``candidates``: review_id, cand_no, surface, entity_type, start, end, confidence.
    Given offsets are verified. Otherwise the k-th use of a surface in a review takes its
    k-th place: exact, ignoring case, with other white space, or in another Bangla spelling.
    Candidates of one surface in one review are walked in order inside an array.

    A text is sent once to its verified candidates and once to its walked ones; what they take of it (surface and sentence) is cut there,
    so no row carries a text any further.
    """
    t = texts.select("review_id", "review_text")
    c = candidates.withColumn("s", T.strip(F.coalesce("surface", F.lit("")))).withColumn(
        "kind", F.upper(T.strip(F.coalesce("entity_type", F.lit("")))))
    early = F.when(F.col("s") == "", "empty-surface").when(
        ~F.col("kind").isin(vocab.ENTITY_TYPES), F.concat(F.lit("unknown-type:"), F.coalesce(F.nullif("kind", F.lit("")), F.lit("blank"))))
    c = c.withColumn("early", early).withColumn("offered", F.col("start").isNotNull() & F.col("end").isNotNull())
    ids = t.select("review_id")  # candidates come once per text of their id
    held = F.substring("review_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("s")
    in_range = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("review_text"))
    cols = ["review_id", "cand_no", "surface", "s", "kind", "confidence"]
    cut = lambda text, at, to: (F.substring(text, at + 1, to - at).alias("said"), sentence(text, at, to).alias("sentence"))
    verified = c.filter("early IS NULL AND offered").join(t, "review_id", "left").select(
        *cols, F.when(~in_range, "offsets-out-of-range").when(~held, "offsets-do-not-hold-surface").alias("reason"),
        F.col("start").cast("int").alias("at"), F.col("end").cast("int").alias("to"), F.lit("exact").alias("match_kind"), "review_text").select(
        *cols, "reason", "at", "to", "match_kind", *[F.when(F.col("reason").isNull(), x).alias(n) for x, n in zip(cut(F.col("review_text"), F.col("at"), F.col("to")), ("said", "sentence"))])

    search = c.filter("early IS NULL AND NOT offered").join(ids, "review_id", "left").withColumn("low", F.lower("s"))
    packed = search.groupBy("review_id", "low").agg(F.array_sort(F.collect_list(F.struct("cand_no", "s"))).alias("list")).join(
        t.groupBy("review_id").agg(F.first("review_text").alias("body")), "review_id", "left")
    step = "struct<resume:int,out:array<struct<cand_no:bigint,s:string,at:int,len:int,kind:string,resume:int,nth:int>>>"
    body, low_body = F.col("body"), F.col("low_body")

    def walk(acc, x):
        r = acc["resume"]
        exact = F.position(x["s"], body, r + 1)
        case = F.position(F.lower(x["s"]), low_body, r + 1)
        words = F.filter(F.split(x["s"], T.WS + "+"), lambda w: w != "")
        flexible = F.concat(F.lit("(?iu)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), T.WS + "+"))
        rest = F.substring(body, r + 1, F.length(body))
        loose = F.regexp_substr(rest, flexible)
        at = F.when(exact > 0, exact - 1).when(case > 0, case - 1).when(loose.isNotNull(), r + F.position(loose, rest) - 1)
        n = F.when((exact > 0) | (case > 0), F.length(x["s"])).otherwise(F.length(loose))
        kind = F.when(exact > 0, "exact").when(case > 0, "case").when(loose.isNotNull(), "whitespace")
        hit = F.struct(x["cand_no"].cast("bigint").alias("cand_no"), x["s"].alias("s"), at.cast("int").alias("at"), n.cast("int").alias("len"), kind.alias("kind"),
                       r.alias("resume"), (1 + F.size(F.filter(acc["out"], lambda h: h["at"].isNull()))).alias("nth"))
        return F.struct(F.coalesce(at + n, r).cast("int").alias("resume"), F.concat(acc["out"], F.array(hit)).alias("out")).cast(step)

    start = F.struct(F.lit(0).alias("resume"), F.array().cast("array<struct<cand_no:bigint,s:string,at:int,len:int,kind:string,resume:int,nth:int>>").alias("out")).cast(step)
    walked = packed.withColumn("low_body", F.lower("body")).select("review_id", "body", F.explode(F.aggregate("list", start, walk)["out"]).alias("h")).select(
        "review_id", "body", "h.*")
    respell = F.col("at").isNull() & F.col("s").rlike(BENGALI) & (normalize_bangla(F.col("s")) != F.col("s"))
    found = walked.withColumn("n", _normalized_find(F.when(respell, F.col("body")), F.when(respell, normalize_bangla(F.col("s"))), F.coalesce("resume", F.lit(0)), F.coalesce("nth", F.lit(1))))
    found = found.withColumn("match_kind", F.coalesce("kind", F.when(F.col("n.at").isNotNull(), "normalized"))).withColumn(
        "len", F.coalesce("len", "n.len")).withColumn("at", F.coalesce("at", "n.at")).withColumn("to", F.col("at") + F.col("len"))
    found = found.select("review_id", "cand_no", F.when(F.col("at").isNull(), "not-in-source").alias("reason"), "at", "to", "match_kind", *cut(F.col("body"), F.col("at"), F.col("to")))
    searched = search.join(found, ["review_id", "cand_no"]).select(*cols, "reason", "at", "to", "match_kind", "said", "sentence")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    refused = c.filter("early IS NOT NULL").join(ids, "review_id", "left").select(
        *cols, F.col("early").alias("reason"), none("int", "at"), none("int", "to"), *[none("string", n) for n in ("match_kind", "said", "sentence")])
    judged = verified.unionByName(searched).unionByName(refused)
    span = Window.partitionBy("review_id", "kind", "at", "to").orderBy("cand_no")  # uses of one span
    again = F.col("reason").isNull() & (F.row_number().over(span) > 1)
    judged = judged.withColumn("reason", F.when(again, "duplicate-span").otherwise(F.col("reason")))
    ok = F.col("reason").isNull()
    return judged.select(
        "review_id", "cand_no", F.col("kind").alias("entity_type"),
        F.when(ok, F.col("said")).otherwise(F.col("s")).alias("surface"),
        F.when(ok, F.col("at")).alias("start"), F.when(ok, F.col("to")).alias("end"), F.when(ok, F.col("match_kind")).alias("match_kind"),
        F.when(ok, F.col("sentence")).alias("sentence"), "confidence", F.col("reason").alias("drop_reason"))


def sentence(text: Column, start: Column, end: Column) -> Column:
    """The sentence around a span; a boundary is . ! ? danda or a line break."""
    mark = r"[.!?\x{0964}\n]"
    head = F.substring(text, F.lit(1), F.least(start + 1, F.length(text)))
    tail = F.substring(text, end + 1, F.length(text))
    left = F.length(F.regexp_extract(head, rf"(?s)^(.*{mark})", 1))
    inner = F.substring(text, left + 1, end - left)
    right = F.regexp_extract(tail, rf"(?s)^([^.!?\x{{0964}}\n]*{mark}?)", 1)
    return T.squeeze(F.concat(inner, right))


def grounding_report(grounded: DataFrame) -> DataFrame:
    """Kept and dropped by match kind and reason."""
    kept = F.col("drop_reason").isNull()
    return grounded.groupBy(
        F.when(kept, "kept").otherwise("dropped").alias("outcome"),
        F.when(kept, F.col("match_kind")).otherwise(F.regexp_extract("drop_reason", "^[^:]+", 0)).alias("detail")).agg(F.count(ONE).alias("n"))


def concept_table(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct reviews, mentions and spellings per concept."""
    lex = lexicon.select(F.lower(normalize_bangla(F.col("surface"))).alias("key"), F.upper("entity_type").alias("entity_type"), "concept").distinct()
    m = mentions.withColumn("key", F.lower(normalize_bangla(F.col("surface")))).join(broadcast_if_small(lex), ["key", "entity_type"])
    return m.groupBy("concept", "entity_type").agg(
        F.count_distinct("review_id").alias("n_reviews"), F.count(ONE).alias("n_mentions"), F.count_distinct("surface").alias("n_spellings"))


def with_sound(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("phonetic_key", phonetic_key(F.col("surface")))
