"""Hand-computed cases and brute-force comparisons on small fixtures."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from roamlens.functions import language as L
from roamlens.functions import text as T
from roamlens.functions import vocab
from roamlens.functions.tasks import indel, token_set
from roamlens.operators import gems, joins, mentions, resolution, rollups, stats


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()[0]


def test_cleaning(spark):
    assert one(spark, T.clean_text(F.col("t")), t="Liked: a &amp; b | Disliked:  c\xa0d ") == "a & b. c d"
    assert one(spark, T.clean_submission(F.col("t")), t="<b>hi</b>\r\n\n\n\nyou\x07 \t there") == "hi \n\nyou there"


def test_phonetic_keys_meet(spark):
    rows = spark.createDataFrame([("গুলিয়াখালি",), ("Guliakhali",), ("Gulyakhali",)], ["t"]).select(L.phonetic_key("t").alias("k")).collect()
    assert len({r.k for r in rows}) == 1


@pytest.mark.parametrize("text,label,method", [
    ("", "", "empty"), ("123 !!", "", "no-letters"), ("আমরা hotel টা পছন্দ করেছি", "bn", "script"),
    ("Khub sundor jayga", "bn-latn", "heuristic"), ("Nice place", "en", "short-text"), ("সুন্দর জায়গা very nice", "mixed", "script-mix")])
def test_language_labels(spark, text, label, method):
    got = one(spark, L.language_label(F.col("t")), t=text)
    assert (got["label"], got["method"]) == (label, method)


def test_indel_and_token_set():
    assert indel("abc", "abc") == 100 and indel("abc", "axc") == pytest.approx(200 * 2 / 6)
    assert token_set("saint martin", "saint martin island") == 100


def test_bigram_candidates_miss_nothing(spark):
    words = ["kuakata", "kuakta", "kuakatta", "jaflong", "jaflang", "jafflong", "ab", "abc", "a", "ratargul", "ratargol", "bisnakandi", "bichnakandi"]
    df = spark.createDataFrame([(w, w) for w in words], ["id", "key"])
    for ratio in (0.75, 0.8):
        got = {(r.lid, r.rid) for r in joins.bigram_candidates(df, df, ratio).collect()}
        need = {(a, b) for a, b in itertools.product(words, words) if indel(a, b) >= 100 * ratio}
        assert need <= got


GROUPS = [
    # surface, type, districts, divisions
    ("Kuakata", "PLACE", ["Patuakhali"], ["Barishal"]), ("KUAKATA", "PLACE", ["Barguna"], ["Barishal"]), ("kuakata", "PLACE", ["Sylhet"], ["Sylhet"]),
    ("Kuakata Beach", "PLACE", ["Patuakhali"], ["Barishal"]), ("Kuakata Sea Beach", "PLACE", [], []), ("কুয়াকাটা", "PLACE", ["Patuakhali"], ["Barishal"]),
    ("Guliakhali", "PLACE", ["Chattogram"], ["Chattogram"]), ("Gulyakhali", "PLACE", ["Chattogram"], ["Chattogram"]), ("Guliyakhali", "PLACE", ["Dhaka"], ["Dhaka"]),
    ("Jaflong", "PLACE", ["Sylhet"], ["Sylhet"]), ("Jaflong Zero Point", "PLACE", ["Sylhet"], ["Sylhet"]), ("Jaflong", "FOOD", ["Sylhet"], ["Sylhet"]),
    ("Tea Garden", "PLACE", ["Sylhet"], ["Sylhet"]), ("Tea", "FOOD", ["Sylhet"], ["Sylhet"]), ("Nilgiri Hills", "PLACE", ["Bandarban"], ["Chattogram"]),
    ("Nilgiri", "PLACE", ["Dhaka"], ["Dhaka"]), ("নীলগিরি", "PLACE", [], []), ("Mongla", "PLACE", ["Bagerhat"], ["Khulna"]), ("Mangal", "PLACE", ["Bagerhat"], ["Khulna"]),
    ("Saint Martin", "PLACE", ["Cox's Bazar"], ["Chattogram"]), ("Saint Martin Island", "PLACE", ["Cox's Bazar"], ["Chattogram"]), ("সেন্ট মার্টিন", "PLACE", ["Cox's Bazar"], ["Chattogram"]),
]


def _groups(spark):
    rows = [(s if t == "PLACE" else f"{s} ", t, d, v) for s, t, d, v in GROUPS]
    df = spark.createDataFrame(rows, "surface string, entity_type string, districts array<string>, divisions array<string>")
    return resolution.describe(df.withColumn("target", F.lit(None).cast("string")).withColumn("mentions", F.lit(1)))


def _score(a, b):
    ka, kb = set(a.key_tokens), set(b.key_tokens)
    sig = {"phonetic": 1.0 if ka and ka == kb else 0.75 if ka and kb and (ka < kb or kb < ka) else 0.0}
    if a.bengali == b.bengali:
        r = max(token_set(a.normalized, b.normalized), indel(a.normalized, b.normalized))
        sig["string"] = r / 100 if r >= 70 else 0.0
        na, nb = set(a.normalized.split()), set(b.normalized.split())
        small, big = (na, nb) if len(na) < len(nb) else (nb, na)
        sig["containment"] = 1.0 if na != nb and small < big and big - small <= set(vocab.CATEGORY_WORDS) else 0.0
    da, db, va, vb = set(a.districts), set(b.districts), set(a.divisions), set(b.divisions)
    sig["geography"] = 1.0 if da & db else 0.6 if va & vb else -0.5 if da and db else 0.0
    w = vocab.PAIR_WEIGHTS
    return sum(w[k] * v for k, v in sig.items()) / sum(w[k] for k in sig)


def test_resolution_equals_all_pairs(spark):
    g = _groups(spark)
    rows = g.collect()
    parent = {r.surface: r.surface for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if a.entity_type == b.entity_type and _score(a, b) >= vocab.MERGE_THRESHOLD - 1e-12:
            parent[find(b.surface)] = find(a.surface)
    want = {}
    for s in parent:
        want.setdefault(find(s), set()).add(s)
    got = {}
    for r in resolution.resolve(g).collect():
        got.setdefault(r.root, set()).add(r.surface)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_resolution_with_vectors_equals_all_pairs(spark):
    g = _groups(spark)
    rows, rng = g.collect(), random.Random(8)
    base = {w: [rng.gauss(0, 1) for _ in range(6)] for w in {r.surface.split()[0].lower() for r in rows}}
    vectors = {r.surface: [x + rng.gauss(0, 0.4) for x in base[r.surface.split()[0].lower()]] for r in rows if rng.random() < 0.8}
    parent = {r.surface: r.surface for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if a.entity_type == b.entity_type:
            score = _score(a, b)
            if a.surface in vectors and b.surface in vectors:
                u, v = vectors[a.surface], vectors[b.surface]
                score = (score + sum(x * y for x, y in zip(u, v)) / math.dist(u, [0] * 6) / math.dist(v, [0] * 6)) / 2
            if score >= vocab.MERGE_THRESHOLD - 1e-12:
                parent[find(b.surface)] = find(a.surface)
    want, got = {}, {}
    for s in parent:
        want.setdefault(find(s), set()).add(s)
    frame = spark.createDataFrame(list(vectors.items()), "surface string, embedding array<double>")
    for r in resolution.resolve_with_vectors(g, frame).collect():
        got.setdefault(r.root, set()).add(r.surface)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 1 < len(want) < len(rows)


def test_bcubed(spark):
    gold = spark.createDataFrame([(i, 0) for i in "abcd"], ["item", "label"])
    for clusters, recall in (([0, 0, 1, 1], 0.5), ([0, 1, 2, 3], 0.25)):
        got = resolution.bcubed(spark.createDataFrame(list(zip("abcd", clusters)), ["item", "cluster"]), gold).first()
        assert got.recall == recall and got.precision == 1.0


def test_grounding(spark):
    texts = spark.createDataFrame([("r1", "We saw Fatrar Chor, then cox's  bazar. Fatrar Chor again!")], ["review_id", "review_text"])
    rows = [("r1", 1, "Fatrar Chor", "PLACE"), ("r1", 2, "Fatrar Chor", "PLACE"), ("r1", 3, "Fatrar Chor", "PLACE"), ("r1", 4, "Cox's Bazar", "PLACE"),
            ("r1", 5, "Nilgiri Hills", "PLACE"), ("r1", 6, "", "PLACE"), ("r1", 7, "kotkoti", "SNACK")]
    c = spark.createDataFrame([(*r, None, None, None) for r in rows], "review_id string, cand_no long, surface string, entity_type string, start int, end int, confidence double")
    got = {r.cand_no: r for r in mentions.ground(c, texts).collect()}
    assert [got[i].start for i in (1, 2)] == [7, 39] and got[3].drop_reason == "not-in-source"
    assert (got[4].match_kind, got[4].surface) == ("whitespace", "cox's  bazar")
    assert [got[i].drop_reason for i in (5, 6, 7)] == ["not-in-source", "empty-surface", "unknown-type:SNACK"]


def test_gem_rules(spark):
    look = spark.createDataFrame([("a", "error", "error", False, False, None, None), ("b", "ok", "error", False, False, None, None), ("c", "ok", "ok", False, False, None, None)],
                                 "entity_id string, osm_status string, wikidata_status string, osm_found boolean, wikidata_found boolean, osm_importance double, wikidata_sitelinks int")
    assert {r.entity_id: r.visibility for r in gems.visibility(look).collect()} == {"a": "unknown", "b": "unknown", "c": "V0"}
    with pytest.raises(ValueError):
        gems.weighted_score(set(gems.TERMS))


def test_kappa_and_fisher(spark):
    rows, k = [], 0
    for n, (x, y) in ((20, (1, 1)), (5, (1, 0)), (10, (0, 1)), (15, (0, 0))):
        for _ in range(n):
            rows += [(k, "a", x), (k, "b", y)]
            k += 1
    assert stats.cohen_kappa(spark.createDataFrame(rows, ["pair_key", "annotator", "label"])).first().cohen_kappa == 0.4
    got = stats.fisher_exact(spark.createDataFrame([(1, 3, 1, 1, 3), (2, 30, 12, 9, 40)], ["table_id", "a", "b", "c", "d"])).collect()
    p = {r.table_id: r.p_two_sided for r in got}

    def exact(a, b, c, d):
        pr = lambda x: math.comb(a + c, x) * math.comb(b + d, a + b - x) / math.comb(a + b + c + d, a + b)
        return min(1.0, sum(pr(x) for x in range(max(0, a - d), min(a + b, a + c) + 1) if pr(x) <= pr(a) * (1 + 1e-9)))

    assert p[1] == pytest.approx(exact(3, 1, 1, 3), abs=1e-6) and p[2] == pytest.approx(exact(30, 12, 9, 40), abs=1e-6)


def test_water_level(spark):
    places = [(i, "D", 40 + 13 * i % 300, 5 * i % 60) for i in range(40)]
    p = spark.createDataFrame(places, ["place_id", "division", "review_count", "existing"])
    got = {r.place_id: r.target_new for r in rollups.water_level(p, spark.createDataFrame([("D", 900)], ["division", "quota"])).collect()}
    caps = {i: max(0, rc - e) for i, _, rc, e in places}
    assert sum(got.values()) == min(900, sum(caps.values())) and all(got[i] <= caps[i] for i in got)


def test_id_claims_follow_root_order(spark):
    clusters = spark.createDataFrame([("s1", "r1"), ("s2", "r2"), ("s3", "r2"), ("s4", "r3"), ("s5", "r4")], ["surface", "root"])
    registry = spark.createDataFrame([("s1", "E0001"), ("s2", "E0001"), ("s3", "E0002"), ("s4", "E0002")], ["surface", "entity_id"])
    got = {r.root: (r.entity_id, r.status) for r in resolution.assign_ids(clusters, registry).collect()}
    assert got == {"r1": ("E0001", "kept"), "r2": ("E0002", "kept"), "r3": ("E0003", "new"), "r4": ("E0004", "new")}
