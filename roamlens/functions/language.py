"""Bangla normalisation, sound keys and the script-based language label."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roamlens.functions import vocab
from roamlens.functions.text import WS, squeeze

BENGALI = r"[\x{0980}-\x{09ff}]"
LATIN = "[A-Za-z]"
NOT_WS = WS.replace("[", "[^", 1)
_FOREIGN_MARK = r"[\p{M}&&[^\x{0980}-\x{09ff}]]"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def compose(text: Column) -> Column:
    """Canonical composition. Bangla is composed by replacement; only texts with other
    combining marks cross to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_FOREIGN_MARK), text)), text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often the result names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_bangla(text: Column) -> Column:
    """One spelling per rendered Bangla text, safe as a matching key. Letters are composed only where there are Bangla ones."""
    invisible = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in vocab.INVISIBLE_CHARS) + "]+"
    out = F.regexp_replace(compose(F.coalesce(text, F.lit(""))), invisible, "")

    def composed(t: Column) -> Column:
        joined = t
        for sequence, single in vocab.BENGALI_COMPOSE:
            joined = F.replace(joined, F.lit(sequence), F.lit(single))
        return F.when(t.rlike(BENGALI), joined).otherwise(t)

    return squeeze(bound(out, composed))


def _to_latin(text: Column) -> Column:
    return bound(text, lambda t: F.when(t.rlike(BENGALI), _sounds(t)).otherwise(t))


def _sounds(text: Column) -> Column:
    for letter, sound in vocab.BENGALI_SOUNDS.items():
        if len(sound) > 1:
            text = F.replace(text, F.lit(letter), F.lit(sound))
    kept = [(k, s) for k, s in vocab.BENGALI_SOUNDS.items() if len(s) == 1]
    silent = [k for k, s in vocab.BENGALI_SOUNDS.items() if s == ""]
    return F.translate(text, "".join(k for k, _ in kept) + "".join(silent), "".join(s for _, s in kept))


def phonetic_key(text: Column) -> Column:
    """Consonant skeleton shared by a Bangla name and its romanisations."""
    key = _to_latin(F.lower(normalize_bangla(text)))
    key = F.regexp_replace(key, r"[^a-z\p{Nd} ]+", "")
    for source, target in vocab.LATIN_FOLDS:
        key = F.replace(key, F.lit(source), F.lit(target))
    key = F.regexp_replace(key, r"(?<=\S)[aeiouy]+", "")
    key = F.regexp_replace(key, r"(\S)\1+", "$1")
    return squeeze(key)


def loose_key(text: Column) -> Column:
    """Phonetic key without the spelling habits Bangla does not share."""
    return loosened(phonetic_key(text))


def loosened(key: Column) -> Column:
    """The loose key of a phonetic key."""
    key = F.replace(F.replace(key, F.lit("ng"), F.lit("n")), F.lit("ck"), F.lit("k"))
    return F.regexp_replace(key, r"(?<=\S{3})[sh](?= |$)", "")


def letters(key: Column) -> Column:
    return F.length(F.replace(key, F.lit(" "), F.lit("")))


def _run_letters(text: Column, letter: str) -> Column:
    """How many characters of a kind there are, counted by runs."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{letter}+", ""))


def script_counts(text: Column) -> tuple[Column, Column]:
    body = F.coalesce(text, F.lit(""))
    return F.when(body.rlike(BENGALI), _run_letters(body, BENGALI)).otherwise(0), _run_letters(body, LATIN)


def script_shares(text: Column) -> tuple[Column, Column]:
    """Share of the letters that are Bengali, and that are Latin; 0 without letters."""
    bn, la = script_counts(text)
    total = bn + la
    return (
        F.coalesce(F.try_divide(bn, total), F.lit(0.0)),
        F.coalesce(F.try_divide(la, total), F.lit(0.0)),
    )


def script_words(text: Column) -> tuple[Column, Column]:
    """Words mostly Bengali, and mostly Latin. Ties count as Bengali."""
    both = word_scripts(F.coalesce(text, F.lit("")))
    return both["bn"], both["la"]


def word_scripts(body: Column) -> Column:
    """Struct(bn, la) of the words mostly of each script; only texts with both scripts are looked at word by word."""
    holding = lambda letter, t: F.regexp_count(t, F.lit(f"{letter}{NOT_WS}*+"))  # noqa: E731  # from its first letter to its end
    pair = lambda bn, la: F.struct(bn.cast("int").alias("bn"), la.cast("int").alias("la"))

    def each(t: Column) -> Column:
        words = F.filter(F.split(t, WS + "+"), lambda w: w.rlike(BENGALI) | w.rlike(LATIN))
        more = F.transform(words, lambda w: _run_letters(w, BENGALI) - _run_letters(w, LATIN))
        return bound(more, lambda d: pair(F.size(F.filter(d, lambda x: x >= 0)), F.size(F.filter(d, lambda x: x < 0))))

    zero = F.lit(0)
    return bound(body, lambda t: F.when(~t.rlike(BENGALI), pair(zero, holding(LATIN, t))).when(~t.rlike(LATIN), pair(holding(BENGALI, t), zero)).otherwise(each(t)))


def coarse_language(text: Column, detected: Column | None = None) -> Column:
    """``bn``, ``bn-en-mixed``, short Latin as ``en``, else the detector's answer."""
    bengali, latin = text.rlike(BENGALI), text.rlike(LATIN)
    fallback = F.when(latin, F.lit("en")).otherwise(F.lit("unknown"))
    return (
        F.when(bengali & latin, "bn-en-mixed").when(bengali, "bn")
        .when((F.length(text) < vocab.SHORT_TEXT_MAX) & latin, "en")
        .otherwise(fallback if detected is None else F.coalesce(detected, fallback))
    )


def language_label(text: Column, detected_iso: Column | None = None,
                   romanised: Column | None = None, romanised_confidence: Column | None = None) -> Column:
    """Struct(label, confidence, method, iso) for one text.

    ``romanised`` is a trained model's decision; without it a marker-word rule decides.
    ``detected_iso`` is asked only for longer Latin text that is not romanised Bangla.
    Confidence stays NULL where a rule decided.
    """
    none, empty = F.lit(None).cast("double"), F.lit("")

    def out(label, conf, how, iso):
        return F.struct(
            label.alias("label"), F.bround(conf, 4).cast("double").alias("confidence"),
            how.alias("method"), iso.alias("iso"),
        )

    def romanised_or(lowered: Column, otherwise: Column) -> Column:
        """Marker words decide, or the given model; the words are taken apart once."""
        clause = F.regexp_count(lowered, F.lit(vocab.ENGLISH_CLAUSE)) >= 2
        label = F.when(clause, "mixed").otherwise("bn-latn")
        if romanised is not None:
            return F.when(romanised, out(label, romanised_confidence, F.lit("classifier"), F.lit("bn-latn"))).otherwise(otherwise)
        words = F.regexp_extract_all(lowered, F.lit("[a-z]+"), F.lit(0))
        markers = F.regexp_count(lowered, F.lit("(?<![a-z])(?:" + "|".join(sorted(vocab.BANGLISH_MARKERS, key=lambda m: (-len(m), m))) + ")(?![a-z])"))

        def ruled(hits: Column) -> Column:
            share = lambda n: F.least(F.lit(1.0), hits / n * 3)
            by_rule = bound(F.when(hits > 0, F.size(words)), lambda n: F.when(
                (hits >= 2) | ((hits == 1) & (n <= 6)), out(label, share(n), F.lit("heuristic"), F.lit("bn-latn"))).otherwise(otherwise))
            return F.when(hits == 0, otherwise).otherwise(by_rule)

        return bound(markers, ruled)

    iso = F.lit(None).cast("string") if detected_iso is None else detected_iso

    def latin(body: Column) -> Column:
        rest = (
            F.when(F.length(body) < vocab.SHORT_TEXT_MAX, out(F.lit("en"), none, F.lit("short-text"), F.lit("en")))
            .when(iso.isNotNull() & (iso != "en"), out(F.lit("other"), none, F.lit("lid"), iso))
            .when(iso.isNotNull(), out(F.lit("en"), none, F.lit("lid"), iso))
            .otherwise(out(F.lit("en"), none, F.lit("script"), F.lit("en")))
        )
        return bound(F.lower(body), lambda low: romanised_or(low, rest))

    def two_scripts(body: Column) -> Column:
        def judged(w: Column) -> Column:
            total, minority = w["bn"] + w["la"], F.least(w["bn"], w["la"])
            share = F.coalesce(F.try_divide(minority, total), F.lit(0.0))
            bn, la = script_counts(body)
            return (
                F.when((minority >= vocab.MIXED_MIN_WORDS) & (share >= vocab.MIXED_MIN_SHARE), out(F.lit("mixed"), share * 2, F.lit("script-mix"), empty))
                .when(bn > la, out(F.lit("bn"), none, F.lit("script"), F.lit("bn"))).otherwise(latin(body))
            )

        return bound(word_scripts(body), judged)

    # One script alone needs no count: there is no minority and no contest.
    return bound(normalize_bangla(text), lambda body: (
        F.when(body == "", out(empty, F.lit(0.0), F.lit("empty"), empty))
        .when(body.rlike(BENGALI), F.when(body.rlike(LATIN), two_scripts(body)).otherwise(out(F.lit("bn"), none, F.lit("script"), F.lit("bn"))))
        .when(body.rlike(LATIN), latin(body))
        .otherwise(out(empty, none, F.lit("no-letters"), empty))))


def strip_ending(word: Column) -> Column:
    """One Bangla case ending removed, longest first, at least two letters left."""
    longest_first = sorted(vocab.BANGLA_SUFFIXES, key=lambda s: (-len(s), s))
    out = None
    for suffix in longest_first:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + 2)
        cut = F.left(word, F.length(word) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def term_regex(term: Column) -> Column:
    """A pattern finding a term as a whole word; endings are allowed but not matched."""
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    bn = r"[\p{L}\p{N}_\x{0980}-\x{09ff}]"
    endings = "|".join(sorted(vocab.BANGLA_SUFFIXES, key=lambda s: (-len(s), s)))
    bangla = F.concat(F.lit(f"(?<!{bn})"), quoted, F.lit(f"(?=(?:{endings})?(?!{bn}))"))
    latin = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?=(?:e?s)?(?![\p{L}\p{N}_]))"))
    return F.when(term.rlike(BENGALI), bangla).otherwise(latin)
