"""Steps that met the limits: results by plain Python, and plans that read and send no more than needed."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd

from roamlens.functions import vocab
from roamlens.functions.tasks import fill_days, indel
from roamlens.operators import alike, gems, joins, models, planning


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_read_and_scored_once(spark):
    rows = [("e1", " good bad good "), ("e1", "good bad good"), ("e1", None), ("e1", " "), ("e2", "nothing known"), ("e2", "ভাল good"), (None, "good"), ("e3", "ভাল ভাল")]
    mentions = spark.createDataFrame(rows * 2, "entity_id string, sentence string")
    weights = {"good": 2.0, "bad": -1.0}
    got = gems.term_sentiment(mentions, spark.createDataFrame([*weights.items()], "word string, weight double"))
    assert len(re.findall("LogicalRDD|Relation|LocalRelation", plan_of(got))) == 2  # the mentions and the weights, once each
    said = defaultdict(list)
    for e, s in rows * 2:
        letters = Counter("la" if c.isascii() else "bn" for c in (s or "") if c.isalpha())
        if e and letters["la"] and letters["la"] / letters.total() >= vocab.LATIN_SENTENCE_SHARE:
            x = sum(weights.get(w, 0.0) for w in s.split())
            said[e].append(x / math.sqrt(x * x + 15))
    want = {e: (round((sum(c) / len(c) + 1) / 2, 9), len(c)) for e, c in said.items()}
    assert {r.entity_id: (round(r.term_sentiment, 9), r.n_sentiment_sentences) for r in got.collect()} == want


def distances(mentions, reviews, stop):
    """term_distinct by plain Python; rows that share an id are one document."""
    words = lambda t: [w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in stop]
    doc = lambda side, i: (side, i) if i is not None else (None, None)
    tf = defaultdict(Counter)
    for side, i, text in [("r", r[0], r[2]) for r in reviews] + [("m", m[0], m[3]) for m in mentions]:
        tf[doc(side, i)].update(words(text))
    df, n = Counter(w for c in tf.values() for w in c), len(reviews) + len(mentions)
    unit = {}
    for d, c in tf.items():
        raw = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        unit[d] = {w: x / norm for w, x in raw.items()} if d[1] is not None else {}
    centre, size = defaultdict(Counter), Counter(p for _, p, _ in reviews)
    for i, p, _ in reviews:
        for w, x in unit[doc("r", i)].items():
            centre[p][w] += x
    rows = [(i, e, p) for i, e, r, text in mentions if (text or "").strip() for q, p, _ in reviews if r is not None and q == r and p is not None and centre[p]]
    dots = Counter()
    for i, _, p in rows:
        dots[i] += sum(x * centre[p][w] for w, x in unit[doc("m", i)].items())
    out = defaultdict(list)
    for i, e, p in rows:
        length = math.sqrt(sum((x / size[p]) ** 2 for x in centre[p].values()))
        out[e].append(max(0.0, min(1.0, 1 - (dots[i] if i is not None else 0) / size[p] / length)))
    return {e: round(sum(v) / len(v), 9) for e, v in out.items()}


def test_distances_with_and_without_shared_ids(spark):
    reviews = [("1", "p", "red tea and tea"), ("2", "p", "green tea"), ("3", "q", "old fort"), ("4", None, "lost place"), ("5", "q", None), ("6", "s", "")]
    mentions = [("a", "x", "1", "red tea"), ("b", "x", "2", "red tea"), ("c", "x", "3", "the fort the fort"), ("d", "y", "1", "red tea"), ("e", "y", "4", "lost"),
                ("f", "y", "9", "no review"), ("g", "z", "5", "and the"), ("h", "z", "1", " "), ("i", None, "2", "green"), ("j", "w", None, "green"), ("k", "w", "6", "old")]
    odd_reviews = [*reviews, ("1", "p", "more tea"), ("2", "q", "green fort"), (None, "p", "tea"), (None, "q", "tea fort")]
    odd_mentions = [*mentions, ("a", "x", "1", "red tea"), ("b", "y", "3", "old fort"), (None, "x", "1", "tea"), (None, "y", "3", "tea")]
    for m, r in ((mentions, reviews), (odd_mentions, odd_reviews)):
        got = gems.term_distinct(spark.createDataFrame(m, "mention_id string, entity_id string, review_id string, sentence string"),
                                 spark.createDataFrame(r, "review_id string, place_name string, review_text string"), ["the", "and"])
        if m is mentions and r is reviews:
            assert not re.findall(r"Join \w+, \(doc#", plan_of(got))  # no row per mention and word is sent when ids are unique
        assert {x.entity_id: round(x.term_distinct, 9) for x in got.collect()} == distances(m, r, ["the", "and"])


def test_equal_trips_are_planned_once(spark):
    wish = "request_id string, days int, pace string, wanted array<string>, city string, division string, exclude_cities array<string>, min_reviews int, max_regions int"
    a, b = (2, "standard", ["P1"], None, None, [], 1, None), (1, "packed", [], None, "d1", [], 1, None)
    asked = [("1", *a), ("2", *a), ("3", *b), ("4", *a), ("5", *b), ("5", *b), (None, *a)]
    requests = spark.createDataFrame(asked, wish)
    stats = spark.createDataFrame([(i, f"n{i}", f"c{i % 2}", f"s{i % 3}", f"d{i % 2}", "sight", "attraction", i + 1, i % 5 + 0.5) for i in range(9)],
                                  "place_id long, place_name string, city string, district string, division string, category string, place_kind string, review_count long, avg_review_rating double")
    venue = spark.createDataFrame([(i, "P1", i // 2 + 1) for i in range(0, 9, 2)], "place_id long, preference_id string, review_count long")
    wishes, members = planning.alike(requests)
    assert wishes.count() == 2 + 2 + 1  # two wishes, a repeated id, a null id
    got = planning.for_each(planning.regions(planning.candidates(wishes, stats, venue)), members)
    want = planning.regions(planning.candidates(requests, stats, venue))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_trip_is_filled_without_a_frame_per_day(monkeypatch):
    rows = [(f"d{i % 3}" if i % 4 else None, f"c{i % 5}" if i % 7 else "") for i in range(40)]
    group = pd.DataFrame([("r", "g", 1, i, 100 + i, d, c, 9, 4) for i, (d, c) in enumerate(rows)],
                         columns=["request_id", "region", "region_rank", "pos", "place_id", "district", "city", "region_days", "per_day"])
    want, free = [], list(range(40))
    for day in range(1, 10):
        d, c = rows[free[0]]
        tier = lambda i: -1 if i == free[0] else 0 if d and rows[i][0] == d else 1 if c and rows[i][1] == c else 2  # noqa: E731, B023
        today = sorted(free, key=lambda i: (tier(i), i))[:4]
        want += [[day, k, 100 + i] for k, i in enumerate(today, 1)]
        free = [i for i in free if i not in today]
    sorts, plain = [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    got = fill_days(group.sample(frac=1, random_state=1))
    assert got[["region_day", "stop", "place_id"]].values.tolist() == want and len(sorts) == 1


def test_numbered_names_are_compared_in_blocks(spark):
    listed = [f"stall number {i:04}" for i in range(70)] + ["stall", "x" * 80, "stall number 0001 " + "y" * 60]
    asked = [f"stall nmber {i:04}x" for i in range(0, 140, 2)] + ["x" * 79, "stall number 0001 " + "y" * 59, "number 00", "এক"]
    best = {}
    for a in asked:
        scored = [(-max(indel(a, b) / 100, 0.85 if a in b or b in a else 0.0), b) for b in listed]
        best[a] = sorted(x for x in scored if -x[0] >= vocab.NAME_SUGGEST)[:2]
    frame = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    ids = [frame(v, "id").withColumn("key", joins.F.col("id")) for v in (asked, listed)]
    assert joins.sparse_candidates(*ids, 0.75) is None  # the letter pairs bring most names together
    got = alike.name_suggestions(frame(asked, "place_name"), frame(listed, "name")).collect()
    assert {(r.place_name, r["rank"]): r.suggestion for r in got} == {(a, k): b for a, v in best.items() for k, (_, b) in enumerate(v, 1)}
    near = joins.closest(*ids, 80.0, 1, block=16).collect()
    assert {r.lid: (round(r.similarity, 9), r.rid) for r in near} == {
        a: (round(-s, 9), b) for a in asked for s, b in [min((-indel(a, b), b) for b in listed)] if -s >= 80}


def test_character_pieces_are_made_by_one_pattern_per_length(spark):
    texts = ["The  old\tfort", "a", " \n ", "", None, "😀x 𝒜𝒜𝒜𝒜 é\u2028b", "  ভাল দিন.", "x\u00a0y zz"]
    want = {}
    for t in texts:
        words = [f" {w} " for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w] if t is not None else None
        want[t] = None if words is None else [w[i : i + n] for n in range(1, 5) for w in words for i in range(len(w) + 1 - n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", models.char_grams(joins.F.col("t")).alias("g"))
    assert {r.t: r.g for r in got.collect()} == want
    assert "sequence(" not in plan_of(got)


def test_texts_are_cut_and_hashed_once_for_fitting(spark, monkeypatch):
    rows = [(f"the old fort of {i} kings", "en") for i in range(20)] + [(f"la vieille porte {i} du roi", "fr") for i in range(12)]
    labelled = spark.createDataFrame(rows, "text string, label string")
    read, plain = [], models.Pipeline._fit
    monkeypatch.setattr(models.Pipeline, "_fit", lambda self, data: read.append(plan_of(data)) or plain(self, data))
    model, classes = models.train(labelled, 256)
    models.cross_validate(labelled, 2, 256)
    assert classes == ["en", "fr"] and len(read) == 3 and not any("text" in x or "grams" in x for x in read)
    got = {r.text: r.predicted for r in models.predict(model, classes, labelled).collect()}
    assert got == dict(rows)
