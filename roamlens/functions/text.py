"""Cleaning, name normalisation and small string expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roamlens.functions import vocab

# Every character Python treats as white space; valid in Java and RE2 alike.
WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]")
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}]"
WORD_CHARS = r"\p{L}\p{N}_\x{0980}-\x{09ff}"


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """HTML entities resolved. Only texts holding an ampersand cross to Python."""
    marked = F.when(F.contains(text, F.lit("&")), text)
    return F.coalesce(_unescape(marked), text)


def squeeze(text: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def blank_to_null(text: Column) -> Column:
    """NULL for missing values in any of their spellings: empty, blank or 'nan'."""
    bare = F.lower(strip(text))
    return F.when(bare.isin("", "nan"), None).otherwise(text)


def clean_text(text: Column) -> Column:
    """One review body: entities, form labels and white space. Idempotent."""
    body = unescape(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(body, f"^{WS}*(?:Liked|Disliked):{WS}*", "")
    body = F.regexp_replace(body, rf"{WS}*\|{WS}*(?:Liked|Disliked):{WS}*", ". ")
    return squeeze(body)


def clean_submission(text: Column) -> Column:
    """Markup and control characters removed; the words stay as typed."""
    body = F.coalesce(text, F.lit(""))
    body = F.regexp_replace(body, "\r\n?", "\n")
    body = F.regexp_replace(body, "<[^>]*>", " ")
    body = F.regexp_replace(body, CONTROL, "")
    body = F.regexp_replace(body, "[ \t]+", " ")
    body = F.regexp_replace(body, "\n{3,}", "\n\n")
    return strip(body)


def fingerprint(text: Column) -> Column:
    """Equal for the same text in any spacing or case."""
    return F.sha2(F.lower(squeeze(text)), 256)


def content_id(*fields: Column) -> Column:
    """16 hex digits of the bar-joined fields; a missing field counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.substring(F.md5(joined), 1, 16)


def norm_name(name: Column) -> Column:
    """Comparison form: case, spacing and quote style do not matter."""
    straight = F.translate(F.coalesce(name, F.lit("")), "’‘“”", "''\"\"")
    return F.lower(squeeze(straight))


def strip_qualifier(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(name, F.lit("")), rf"{WS}*\([^)]*\){WS}*$", ""))


def strip_article(name: Column) -> Column:
    plain = squeeze(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(plain, rf"(?i)^the{WS}+", "")
    return F.when(bare == "", plain).otherwise(bare)


def core_name(name: Column) -> Column:
    """Lower-case words that say which place it is, without the kind-of-place words."""
    plain = F.regexp_replace(F.lower(strip_article(name)), "['’]", "")
    words = F.split(F.regexp_replace(plain, f"[^{WORD_CHARS}]+", " "), " ")
    generic = F.array(*[F.lit(w) for w in vocab.GENERIC_WORDS + [""]])
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(generic, w)), " ")


def query_forms(name: Column) -> Column:
    """Name forms to try, most specific first: whole, unqualified, inner, without article."""
    base = strip_qualifier(name)
    inner = strip(F.regexp_extract(name, r"(?s)\((.*)\)", 1))
    forms = F.filter(F.array_distinct(F.array(name, base, inner)), lambda f: f != "")
    plain = F.transform(forms, strip_article)
    return F.array_distinct(F.concat(forms, F.filter(plain, lambda f: f != "")))


def is_generic(surface: Column) -> Column:
    """True when a surface names a kind of place, or nothing."""
    bare = F.regexp_replace(F.lower(squeeze(F.coalesce(surface, F.lit("")))),
                            "^[.,;:!?]+|[.,;:!?]+$", "")
    return (bare == "") | bare.isin(vocab.GENERIC_SURFACES)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case word tokens, punctuation removed, parentheticals kept."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), f"[^{WORD_CHARS}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def spelling_forms(term: Column) -> Column:
    """The term as typed, with nukta letters composed, and decomposed."""
    composed = decomposed = term
    for single, pair in vocab.NUKTA_FORMS:
        composed = F.replace(composed, F.lit(pair), F.lit(single))
        decomposed = F.replace(decomposed, F.lit(single), F.lit(pair))
    return F.array_distinct(F.array(term, composed, decomposed))


def contains_any_form(text: Column, term: Column) -> Column:
    """Case-insensitive substring in any spelling form; no wildcards to escape."""
    lowered = F.lower(text)
    return F.coalesce(F.exists(spelling_forms(term), lambda f: F.contains(lowered, F.lower(f))), F.lit(False))


def keywords_from_topic_name(name: Column) -> Column:
    """``3_good_room_staff`` -> ``good, room, staff``."""
    parts = F.split(F.trim(F.coalesce(name, F.lit(""))), "_")
    numbered = F.element_at(parts, 1).rlike(r"^~*-*\d+$")
    kept = F.when(numbered, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.array_join(F.filter(kept, lambda p: p != ""), ", ")


def singular(word: Column) -> Column:
    """Crude plural stripper for matching."""
    n = F.length(word)
    return (
        F.when((n > 5) & word.rlike("(ches|shes|sses)$"), F.regexp_replace(word, "es$", ""))
        .when((n > 3) & word.rlike("s$") & ~word.rlike("(ss|us|is)$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def shorten(text: Column, limit: int = 280) -> Column:
    """One line, cut to ``limit`` characters with an ellipsis."""
    line = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.concat(F.regexp_replace(F.substring(line, 1, limit - 3), f"{WS}+$", ""), F.lit("..."))
    return F.when(F.length(line) > limit, cut).otherwise(line)


def snippet(text: Column, found_at: Column, width: int = 220) -> Column:
    """A window of squeezed ``text`` around a 1-based position (0 when not found)."""
    at = F.greatest(found_at - 1, F.lit(0))
    start = F.greatest(at - width // 3, F.lit(0))
    piece = F.substring(text, start + 1, F.lit(width))
    lead = F.when(start > 0, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(start + width < F.length(text), F.lit("…")).otherwise(F.lit(""))
    return F.concat(lead, piece, tail)


def to_bool(value: Column) -> Column:
    """1, 0 or NULL from truthy and falsy strings."""
    text = F.lower(strip(value.cast("string")))
    return (
        F.when(text.isin("true", "1", "1.0", "yes", "t"), F.lit(1))
        .when(text.isin("false", "0", "0.0", "no", "f", "", "nan", "none"), F.lit(0))
    )


def rescale_rating(value: Column, scale: float) -> Column:
    return F.bround(value * F.lit(5.0 / scale), 2)
