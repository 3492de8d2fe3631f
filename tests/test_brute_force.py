"""Operators without SQL against brute force on small fixtures."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from roamlens.functions import vocab
from roamlens.functions.similarity import fuzzy_ratio
from roamlens.functions.tasks import indel, token_set
from roamlens.operators import joins, mentions, messages
from tests.test_golden import GROUPS, _groups, _score


def test_fuzzy_ratio_and_pair_scores(spark):
    """Every pair of one type: each signal and the weighted score."""
    g = _groups(spark)
    rows = {r.surface: r for r in g.collect()}
    cols = ["normalized", "key_tokens", "name_tokens", "bengali", "districts", "divisions"]
    a = g.select("entity_type", F.col("surface").alias("id"), F.struct(*cols).alias("a"))
    b = g.select("entity_type", F.col("surface").alias("rid"), F.struct(*cols).alias("b"))
    pairs = joins.pair_signals(a.join(b, "entity_type").filter("id < rid")).withColumn("ratio", fuzzy_ratio("a.normalized", "b.normalized")).collect()
    assert len(pairs) == sum(1 for x, y in itertools.combinations(GROUPS, 2) if x[1] == y[1])
    for r in pairs:
        x, y = rows[r.id], rows[r.rid]
        assert r.score == pytest.approx(_score(x, y))
        assert r.ratio == pytest.approx(max(token_set(x.normalized, y.normalized), indel(x.normalized, y.normalized)))


def test_spelling_proposals_equal_all_pairs(spark):
    rng = random.Random(2)
    words = ["kuakata", "jaflong", "ratargul", "bisnakandi", "nilgiri", "sajek", "boga", "lalakhal", "srimangal", "patenga"]
    places = sorted({" ".join(rng.sample(words, rng.randint(1, 2))) for _ in range(25)})
    names = sorted({"".join(c if rng.random() > 0.12 else rng.choice("aeiou") for c in p) for p in places for _ in range(4)} | {"nothing alike", "বাংলা"})
    decided = names[::7]
    got = {r.variant: (r.place, r.similarity) for r in joins.spelling_proposals(*[
        spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((names, "name"), (places, "place"), (decided, "variant"))]).collect()}
    want = {}
    for n in names:
        if n in places or n in decided or not n.isascii():
            continue
        best = min((-indel(n, p), p) for p in places)
        if -best[0] >= vocab.SPELLING_MIN_SIMILARITY:
            want[n] = best[1], round(-best[0], 1)
    assert set(got) == set(want) and len(want) > 10
    assert all(got[n][0] == p and abs(got[n][1] - s) < 0.11 for n, (p, s) in want.items())


def _metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_near_places_and_duplicates(spark):
    rng = random.Random(3)
    names = ["Sea View", "Sea View Hotel", "Hill Top", "Green Park", "Green Perk", ""]
    rows = [(i, rng.choice(names), 22.0 + rng.random() / 50, 91.0 + rng.random() / 50, rng.randint(0, 9)) for i in range(150)]
    rows += [(200, "Sea View", 22.5, 91.5, 3), (201, "sea  view", 22.5, 91.5, 9), (202, "Sea View", None, 91.0, 1)]
    places = spark.createDataFrame(rows, "place_id long, name string, lat double, lng double, review_count long")
    got = {(r.a_place_id, r.b_place_id): r.metres for r in joins.nearby_places(places, 150).collect()}
    want = {(a[0], b[0]): _metres(a[2:4], b[2:4]) for a, b in itertools.combinations(rows, 2) if a[2] and b[2] and _metres(a[2:4], b[2:4]) <= 150}
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    kept = {r.a_place_id: (r.b_place_id, r.outcome, r.kept_place_id) for r in joins.close_duplicates(places).collect() if {r.a_place_id, r.b_place_id} == {200, 201}}
    assert kept == {201: (200, "merge", 201)}


def _word(ch):
    return bool(re.match(r"[\wঀ-৿]", ch))


def test_lexicon_terms_outside_places(spark):
    """Longer terms first, none over a place, whole words with plural endings."""
    text = "Fish curry and fried fish curries at Fish Market, then boat rides; a boat ride by rice boat. Curryhouse no."
    places = spark.createDataFrame([("r", "PLACE", "Fish Market", 37, 48, "Fish Market")], "review_id string, entity_type string, surface string, start int, end int, name string")
    lexicon = [("fish curry", "FOOD", "curry"), ("fish", "FOOD", "fish"), ("curry", "FOOD", "curry"), ("boat ride", "ACTIVITY", "boating"), ("boat", "TRANSPORT", "boat"), ("rice", "FOOD", "rice")]
    assert text[37:48] == "Fish Market"
    got = {(r.surface, r.start, r.end, r.entity_type, r["name"]) for r in mentions.lexicon_mentions(
        spark.createDataFrame([("r", text)], "review_id string, review_text string"), spark.createDataFrame(lexicon, "surface string, entity_type string, concept string"), places).collect()}
    found = []
    for term, kind, concept in lexicon:
        for m in re.finditer(re.escape(term), text.lower()):
            s, e = m.span()
            after = s2 if (s2 := re.match(r"(?:e?s)?", text[e:].lower()).end() + e) == len(text) or not _word(text[s2]) else e
            if (s == 0 or not _word(text[s - 1])) and (after == len(text) or not _word(text[after])) and not (s < 48 and 37 < e):
                found.append((s - e, text[s:e], s, e, kind, concept))  # an ending may follow, it is not part of the span
    claimed = []
    for _, surface, s, e, kind, concept in sorted(found):
        if not any(s < y and x < e for _, x, y, *_ in claimed):
            claimed.append((surface, s, e, kind, concept))
    assert got == set(claimed) and {"Fish curry", "boat ride", "rice", "boat"} <= {x[0] for x in got}


def test_grounding_report_counts(spark):
    frame = spark.createDataFrame([("exact", None)] * 3 + [("case", None)] + [(None, "unknown-type:SNACK"), (None, "unknown-type:X"), (None, "not-in-source")], "match_kind string, drop_reason string")
    got = {(r.outcome, r.detail): r.n for r in mentions.grounding_report(frame).collect()}
    assert got == {("kept", "exact"): 3, ("kept", "case"): 1, ("dropped", "unknown-type"): 2, ("dropped", "not-in-source"): 1}


def test_translation_outcomes(spark):
    kind = "review_id long, entity_type string, concept string, surface string, secondary boolean"
    original = [(1, "PLACE", "kotka", "Kotka", False), (1, "FOOD", "rice", "Rice", False), (1, "PLACE", "sajek", "Sajek", True), (2, "FOOD", "fish", "Fish", False)]
    translation = [(1, "FOOD", "rice", "rice", False), (2, "FOOD", "tea", "tea", True)]
    words = spark.createDataFrame([(1, "we saw katka and rice".split()), (2, ["tea"])], "review_id long, words array<string>")
    got = {(r.review_id, r.concept): (r.outcome, r.own_place) for r in joins.translation_compare(
        spark.createDataFrame(original, kind), spark.createDataFrame(translation, kind), words).collect()}
    assert got == {(1, "kotka"): ("lost_respelled", True), (1, "rice"): ("kept", True), (1, "sajek"): ("lost_translated_or_dropped", False),
                   (2, "fish"): ("lost_translated_or_dropped", True), (2, "tea"): ("only_in_translation", False)}


def test_best_place_of_a_message_equals_all_matches(spark):
    """The leading place by full name or shared words, without a row for every message and place of a common word."""
    rng = random.Random(6)
    words = ["beach", "hotel", "park", "green", "river", "lake", "hill", "view", "museum", "garden", "royal", "grand"]
    stats = [(i, " ".join(rng.sample(words, rng.randint(1, 4))) + (" (old)" if i % 5 == 0 else ""), rng.randint(0, 30)) for i in range(120)]
    asks = [(i, " ".join(rng.sample(words + ["show", "near", "with", "some"], rng.randint(1, 6)))) for i in range(80)] + [(900, ""), (901, "tell me of lake hill")]
    s = spark.createDataFrame(stats, "place_id long, place_name string, review_count long")
    m = spark.createDataFrame(asks, "message_id long, message string")
    every = messages.place_matches(m, s).join(s, "place_id").collect()
    want = {}
    for r in every:
        key = (-r.score, -r.review_count, r.place_id)
        best = want.setdefault(r.message_id, [key, 0])
        best[0] = min(best[0], key)
        best[1] += r.score >= 100
    got = {r.message_id: (r.place_id, r.n_strong) for r in messages.best_places(m, s).collect()}
    assert got == {k: (v[0][2], v[1]) for k, v in want.items()} and len(got) > 60
