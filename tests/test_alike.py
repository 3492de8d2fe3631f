"""Name joins and vector joins against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamlens.functions.tasks import indel, token_set
from roamlens.operators import alike, topics, vectors


def _names(rng, n, letters="abcdeo ", longest=14):
    return sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).split()) for _ in range(n)} - {""})


@pytest.mark.parametrize("ratio", [0.6, 0.7, 0.92])
def test_letter_candidates_miss_nothing(spark, ratio):
    rng = random.Random(3)
    a, b = _names(rng, 150), _names(rng, 150)
    frames = [spark.createDataFrame([(x, x) for x in side], "id string, key string") for side in (a, b)]
    got = {(r.lid, r.rid) for r in alike.letter_candidates(*frames, F.lit(ratio)).collect()}
    need = {(x, y) for x in a for y in b if indel(x, y) >= 100 * ratio}
    assert need <= got and len(need) > 3 and len(got) < len(a) * len(b) * (0.8 if ratio < 0.7 else 0.5)


def test_name_suggestions_equal_all_pairs(spark):
    rng = random.Random(5)
    stems = _names(rng, 500, "abcdefghiklmnoprstu", 12)
    listed = sorted(set(rng.sample(stems, 250)) | {f"{x} beach" for x in stems[:40]} | {"a", "ab", "天地", "o"})
    asked = sorted({"".join(c for c in x if rng.random() > 0.15) or x for x in stems for _ in range(6)} | {"天", "beach", "zz"})[:2000]
    assert len(asked) > 1000
    want = {}
    for x in asked:
        scored = []
        for y in listed:
            s = indel(x, y) / 100
            s = max(s, 0.85) if x in y or y in x else s
            if s >= 0.6:
                scored.append((-s, y))
        for k, (s, y) in enumerate(sorted(scored)[:2], 1):
            want[x, k] = (round(-s, 2), y)
    got = alike.name_suggestions(spark.createDataFrame([(x,) for x in asked], "place_name string"), spark.createDataFrame([(y,) for y in listed], "name string")).collect()
    assert {(r.place_name, r["rank"]): r.suggestion for r in got} == {k: y for k, (_, y) in want.items()}
    assert all(abs(r.similarity - want[r.place_name, r["rank"]][0]) < 0.0101 for r in got)


def _components(names, need):
    root = {x: x for x in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if root[a] != root[b] and max(token_set(a, b), indel(a, b)) >= need:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {frozenset(k for k, v in root.items() if v == r) for r in set(root.values())}


def _tied(rows, names):
    root = {x: x for x in names}
    hubs = {}
    for r in rows:
        hubs.setdefault(r.hub, []).append(r["name"])
    for members in hubs.values():
        low = min(root[m] for m in members)
        old = {root[m] for m in members}
        root = {k: low if v in old else v for k, v in root.items()}
    return {frozenset(k for k, v in root.items() if v == r) for r in set(root.values())}


@pytest.mark.parametrize("paired", [1, 1000])
def test_alike_groups_are_those_of_all_pairs(spark, paired):
    """Close spellings, shared words, repeated words, names alike to no first name, two thresholds."""
    rng = random.Random(7)
    words = ["nil", "nilgiri", "nilgeri", "hill", "hills", "beach", "sea", "kuakata", "kuakota", "x", "point", "zero", "saint", "martin", "island"]
    rows, want = [], {}
    for area, need in (("d:one", 70.0), ("v:two", 92.0), ("d:three", 70.0)):
        names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(90)} | set(_names(rng, 25, "abcdefg", 8)))
        rows += [(area, x, need) for x in names]
        want[area] = names, _components(names, need)
    frame = spark.createDataFrame(rows, "area string, name string, need double")
    got = alike.alike_groups(frame, ["area"], paired).collect()
    for area, (names, groups) in want.items():
        assert _tied([r for r in got if r.area == area], names) == groups
    assert all(len(g) > 1 for g in (want["d:one"][1], want["v:two"][1]))


def test_a_large_group_is_not_paired(spark):
    """1,200 alike names of one key: a row per name and lead, not per pair."""
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("aeiou") if c == "*" else c for c in "k*k*t* s*nd*rb*n") for _ in range(2000)})[:1200]
    got = alike.alike_groups(spark.createDataFrame([("k", x, 70.0) for x in names], "area string, name string, need double"), ["area"])
    assert got.count() < 17 * len(names)


# ---- vectors ------------------------------------------------------------------------------------
def test_blocked_vector_joins(spark):
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((57, 6)), rng.standard_normal((43, 6))
    b[7] = b[3]
    left, right = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>") for x in (a, b))
    s = a @ b.T
    for block in (10, 4096):
        got = {(r.lid, r.rid): r.score for r in vectors.all_scores(left, right, block).collect()}
        assert len(got) == 57 * 43 and all(abs(got[i, j] - s[i, j]) < 1e-12 for i in range(57) for j in range(43))
        top = {(r.lid, r["rank"]): r.rid for r in vectors.nearest(left, right, 3, block=block).collect()}
        assert top == {(i, k + 1): j for i in range(57) for k, j in enumerate(sorted(range(43), key=lambda j: (-round(s[i, j], 12), j))[:3])}
        other = {r.lid: r.rid for r in vectors.nearest(left, left, 1, other_only=True, block=block).collect()}
        own = a @ a.T
        np.fill_diagonal(own, -np.inf)
        assert other == {i: int(own[i].argmax()) for i in range(57)}
        counts = {r.lid: r.higher for r in vectors.counts_above(left.withColumn("own", F.lit(0.5)), right, block=block).collect()}
        assert counts == {i: int((s[i] > 0.5 + 1e-9).sum()) for i in range(57)}
    assert vectors.nearest(left.limit(0), right, 2).collect() == [] and vectors.all_scores(left, right.limit(0)).collect() == []


def test_nearest_preferences_feed_the_best_two(spark):
    rng = np.random.default_rng(12)
    frame = lambda key, n: spark.createDataFrame([(f"{key}{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((n, 5)))], f"{key} string, vector array<double>")
    t, p = frame("topic_id", 20), frame("preference_id", 9)
    near = topics.nearest_preferences(t, p)
    every = topics.cosine_scores(t, p)
    prefs = p.selectExpr("preference_id", "'c' AS category", "'s' AS subcategory", "preference_id AS preference_label")
    labels = t.selectExpr("topic_id", "topic_id AS interpreted_label")
    assert sorted(topics.best_two(near, prefs, labels).collect()) == sorted(topics.best_two(every, prefs, labels).collect())
    assert near.count() == 40
