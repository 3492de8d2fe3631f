"""Native spellings of known names, mined from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions import vocab
from roamlens.functions.language import letters, loose_key, loosened, normalize_bangla, phonetic_key, strip_ending
from roamlens.operators.joins import reaching
from roamlens.operators.mentions import term_spans
from roamlens.session import broadcast_if_measured, cut_lineage

ONE = "*"  # counted rows
BANGLA_WORD = r"[\x{0981}-\x{09e3}\x{09f0}\x{09f1}]+"


def _bodies(texts: DataFrame) -> DataFrame:
    """Normalised texts that hold a Bangla word, written once: they are read for their words and for their phrases."""
    body = texts.select("review_id", normalize_bangla(F.col("review_text")).alias("review_text"))
    return cut_lineage(body.filter(F.col("review_text").rlike(BANGLA_WORD)))


def _vocabulary(bodies: DataFrame) -> DataFrame:
    """Each different word of the texts with its form without the last ending, and the keys of both (NULL where nothing sounds).

    A key is made word by word, so the key of a phrase is that of its words: no phrase has to be spelled out for it.
    """
    tokens = bodies.select(F.explode(F.array_distinct(F.regexp_extract_all("review_text", F.lit(BANGLA_WORD), F.lit(0)))).alias("token")).distinct()
    known = tokens.withColumn("w", F.regexp_replace("token", "ঃ+$", "")).filter("w <> ''").withColumn("b", strip_ending(F.col("w")))
    known = known.withColumn("wk", phonetic_key(F.col("w"))).withColumn("bk", phonetic_key(F.col("b")))
    some = lambda c: F.nullif(c, F.lit(""))
    return broadcast_if_measured(known.select(
        "token", "w", "b", *[some(F.col(c)).alias(c) for c in ("wk", "bk")], *[some(loosened(F.col(c))).alias(d) for c, d in (("wk", "wl"), ("bk", "bl"))]))


def grams(bodies: DataFrame) -> DataFrame:
    """(review_id, phrase, pk, pl, base, bk, bl): one- to three-word phrases, each also without its last ending, with their keys and loose keys; repeats stay."""
    tok = bodies.select("review_id", F.posexplode(F.regexp_extract_all("review_text", F.lit(BANGLA_WORD), F.lit(0))).alias("pos", "token")).join(
        _vocabulary(bodies), "token")
    w = Window.partitionBy("review_id").orderBy("pos")  # one text
    word = F.struct("w", "b", "wk", "bk", "wl", "bl")
    runs = tok.select("review_id", word.alias("a"), F.lead(word, 1).over(w).alias("n"), F.lead(word, 2).over(w).alias("z"))

    def phrase(*words: str) -> Column:
        *head, last = words
        said = lambda part, end: F.concat_ws(" ", *[F.col(f"{h}.{part}") for h in head], F.col(f"{last}.{end}"))
        return F.when(F.col(last).isNotNull(), F.struct(
            said("w", "w").alias("phrase"), said("wk", "wk").alias("pk"), said("wl", "wl").alias("pl"),
            said("w", "b").alias("base"), said("wk", "bk").alias("bk"), said("wl", "bl").alias("bl")))

    return runs.select("review_id", F.explode(F.array_compact(F.array(phrase("a"), phrase("a", "n"), phrase("a", "n", "z")))).alias("g")).select("review_id", "g.*")


def mine_spellings(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase, place, how, reviews): phrases that sound like a known name.

    The keys of all phrases meet the names by equality (the exact key before the loose one) where the phrase lies, and only those that met one go on.
    A phrase found with and without an ending for one place counts under the shorter form.
    """
    n = cut_lineage(names.select("name", phonetic_key(F.col("name")).alias("k"), loose_key(F.col("name")).alias("l")).filter(letters(F.col("k")) >= vocab.MIN_KEY_LETTERS))
    exact = broadcast_if_measured(n.groupBy("k").agg(F.min("name").alias("pe")))
    loose = broadcast_if_measured(n.groupBy("l").agg(F.min("name").alias("pl")))
    form = lambda o, c, k, l: F.struct(F.lit(o).alias("o"), F.col(c).alias("form"), F.col(k).alias("k"), F.col(l).alias("l"))
    spelled = grams(_bodies(texts)).select("review_id", "phrase", F.explode(F.array_compact(F.array(
        form(0, "phrase", "pk", "pl"), F.when(F.col("base") != F.col("phrase"), form(1, "base", "bk", "bl"))))).alias("f")).select("review_id", "phrase", "f.*")
    hit = (
        spelled.join(loose, "l").join(exact, "k", "left")  # equal keys have equal loose keys
        .withColumn("place", F.coalesce("pe", F.when(letters(F.col("l")) >= vocab.MIN_KEY_LETTERS, F.col("pl"))))
        .filter("place IS NOT NULL")
        .select("review_id", "phrase", "o", "form", "place", F.when(F.col("pe").isNotNull(), "sound").otherwise("loose sound").alias("how")))
    best = hit.groupBy("review_id", "phrase").agg(F.min_by(F.struct("form", "place", "how"), "o").alias("m"))
    found = cut_lineage(best.select("review_id", "m.*").distinct())
    pairs = found.select("form", "place").distinct()
    # An inflected form folds into the shortest found form it ends in an ending of.
    last = F.element_at(F.split("form", " "), -1)
    ends = F.filter(F.array(*[F.lit(s) for s in vocab.BANGLA_SUFFIXES]), lambda s: F.endswith(last, s) & (F.length(last) >= F.length(s) + 2))
    folded = pairs.select("form", "place", F.explode(ends).alias("s")).withColumn("root", F.left("form", F.length("form") - F.length("s")))
    folded = folded.join(pairs.select(F.col("form").alias("root"), "place"), ["root", "place"]).groupBy("form", "place").agg(
        F.min_by("root", F.length("root")).alias("root"))
    final = found.join(broadcast_if_measured(folded), ["form", "place"], "left").withColumn("phrase", F.coalesce("root", "form"))
    return final.groupBy("phrase", "place").agg(
        F.min_by("how", F.when(F.col("root").isNull(), F.lit(0)).otherwise(1)).alias("found_by"), F.count_distinct("review_id").alias("reviews"))


def mine_aligned(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase, place): for each known name in a translation, the original's best-sounding phrase.

    Names are found in translations by word runs. Only the phrases of a review whose
    translation names a place are scored against that place, each distinct (key, key) once. A key that is too long or too short to reach the
    ratio with any name is not compared.
    """
    spans = term_spans(pairs.select("review_id", F.col("translation").alias("review_text")),
                       names.select(F.col("name").alias("term_id"), F.col("name").alias("term")), plurals=False)
    named = cut_lineage(spans.select("review_id", F.col("term_id").alias("name")).distinct())
    told = pairs.select("review_id", F.col("original").alias("review_text")).join(
        broadcast_if_measured(named.select("review_id").distinct()), "review_id", "left_semi")
    heard = cut_lineage(named.join(named.select("name").distinct().withColumn("nk", loose_key(F.col("name"))), "name"))
    known = heard.select(F.col("nk").alias("id")).distinct()
    # 200 c / (n + m) reaches the ratio only if the shorter of n and m letters, which c cannot exceed, does.
    short, long = known.agg(F.coalesce(F.min(F.length("id")), F.lit(0)), F.coalesce(F.max(F.length("id")), F.lit(0))).first()  # two numbers
    least = vocab.ALIGNED_MIN_SIMILARITY / (200 - vocab.ALIGNED_MIN_SIMILARITY)
    form = lambda c, k, is_base: F.struct(F.col(c).alias("form"), F.col(k).alias("fk"), F.lit(is_base).alias("is_base"))
    forms = grams(_bodies(told)).select("review_id", F.explode(F.array_compact(F.array(
        form("phrase", "pl", 0), F.when(F.col("base") != F.col("phrase"), form("base", "bl", 1))))).alias("f")).select("review_id", "f.*").filter(
        (letters(F.col("fk")) >= 2) & (F.length("fk") >= short * least - 1e-9) & (F.length("fk") * least - 1e-9 <= long))
    keys = cut_lineage(forms.select(F.col("fk").alias("id")).distinct())
    ratio = broadcast_if_measured(reaching(known, keys, vocab.ALIGNED_MIN_SIMILARITY).select(F.col("lid").alias("nk"), F.col("rid").alias("fk"), "ratio"))
    scored = forms.join(ratio, "fk").join(heard, ["review_id", "nk"])
    order = F.struct("ratio", (-F.abs(letters(F.col("fk")) - letters(F.col("nk")))).alias("d"), "is_base", "form")
    best = scored.groupBy("review_id", "name").agg(F.max(order).alias("b"))
    return cut_lineage(best.select(F.col("b.form").alias("phrase"), F.col("name").alias("place")).distinct())


def count_phrases(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct reviews the extractor's own matcher finds each phrase in."""
    body = texts.select("review_id", normalize_bangla(F.col("review_text")).alias("review_text"))
    spans = term_spans(body, phrases.select(F.col("phrase").alias("term_id"), F.col("phrase").alias("term")).distinct(), plurals=True)
    n = spans.groupBy(F.col("term_id").alias("phrase")).agg(F.count_distinct("review_id").alias("reviews"))
    return phrases.join(n, "phrase", "left").fillna(0, ["reviews"])
