"""Streams in time order, entity sets, n-grams, folds and requests beyond former caps."""

from __future__ import annotations

import collections

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from roamlens.functions.tasks import fill_days
from roamlens.functions.text import fingerprint
from roamlens.operators import models, prep, resolution, retrieval
from roamlens.plans import load
from roamlens.streaming import arrivals, state


def test_character_grams_of_one_word(spark):
    got = spark.createDataFrame([("abcd abcd",)], ["t"]).select(models.char_grams(F.col("t")).alias("g")).first().g
    word = " abcd "
    want = [word[i : i + n] for n in range(1, 5) for i in range(len(word) - n + 1)]
    assert collections.Counter(got) == collections.Counter(want * 2)


def test_entity_sets_are_united(spark):
    groups = spark.createDataFrame(
        [("Cox Bazar", "PLACE", 5, None, ["A", "B"], ["X"], ["en"], "k1"), ("cox's bazar", "PLACE", 3, "Cox's Bazar", ["B", "C"], ["X", "Y"], ["bn"], "k2"),
         ("lone", "FOOD", 1, None, [], [], ["en"], "k3")],
        "surface string, entity_type string, mentions long, target string, districts array<string>, divisions array<string>, languages array<string>, phonetic_key string")
    clusters = spark.createDataFrame([("Cox Bazar", "r"), ("cox's bazar", "r"), ("lone", "l")], "surface string, root string")
    ids = spark.createDataFrame([("r", "E1"), ("l", "E2")], "root string, entity_id string")
    mentions = spark.createDataFrame([("Cox Bazar", 1), ("cox's bazar", 1), ("cox's bazar", 2), ("lone", 3)], "surface string, review_id long")
    entities, variants = resolution.entity_tables(groups, clusters, ids, mentions)
    got = {r.entity_id: r for r in entities.collect()}
    e = got["E1"]
    assert (e.canonical_name, e.entity_type, e.n_variants, e.n_mentions, e.n_reviews) == ("Cox's Bazar", "PLACE", 2, 8, 2)
    assert (e.districts, e.divisions, e.languages) == (["A", "B", "C"], ["X", "Y"], ["bn", "en"])
    assert (got["E2"].districts, got["E2"].divisions, got["E2"].languages) == ([], [], ["en"])
    assert {(r.surface, r.is_canonical) for r in variants.collect()} == {("Cox Bazar", True), ("cox's bazar", False), ("lone", True)}


def test_repeated_texts_of_any_id(spark):
    """Every later copy is reported, whatever the parity of its id and of the first one's."""
    texts = spark.createDataFrame([(1, "One  text"), (3, "one text"), (4, "ONE TEXT"), (2, "own"), (6, "Two"), (8, "two"), (9, None), (10, None)], "submission_id long, review_text string")
    alone = {r.submission_id for r in prep.repeats(texts.filter("submission_id < 9")).collect()}
    assert alone == {3, 4, 8}
    assert [r.submission_id for r in prep.repeats(texts.filter("submission_id > 8")).collect()] == []


def test_repeated_texts_query_covers_all_documents(spark, sf_dir):
    docs = [(r.doc_id, r.f) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", fingerprint(F.col("text")).alias("f")).collect()]
    first = {f: min(i for i, g in docs if g == f) for f in {f for _, f in docs if f is not None}}
    want = sorted(i for i, f in docs if f is not None and i > first[f])
    asked = {r.s for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS s").collect()}
    got = collections.Counter(r.submission_id for r in load()[0]["pre_16_repeated_texts"](spark, sf_dir).collect())
    assert {i % 2 for i in want} == {0, 1}
    assert all(got[i] >= 1 for i in want) and all(i in asked for i in got if i not in want)


def _flags(events: pd.DataFrame, limit: int, window: float) -> dict:
    out, recent = {}, collections.defaultdict(list)
    for r in events.sort_values(["ts", "event_id"]).itertuples():
        at = r.ts.timestamp()
        held = [t for t in recent[r.client] if at - t < window]
        out[r.event_id] = "accepted" if len(held) < limit else "refused"
        recent[r.client] = held + [at] * (len(held) < limit)
    return out


def test_rate_flag_over_micro_batches_and_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 12_000  # more than one Arrow chunk for the busy client
    events = pd.DataFrame({"client": np.where(rng.random(n + 2000) < n / (n + 2000), "busy", "calm"), "event_id": range(n + 2000),
                           "ts": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(rng.integers(0, 600_000, n + 2000), unit="s")})
    # Three arrivals, each a shuffled stretch of time; one late row comes last.
    order = events.sort_values("ts", ignore_index=True)
    late = pd.DataFrame({"client": ["busy"], "event_id": [10**6], "ts": [events.ts.min()]})
    for k, part in enumerate(np.array_split(order, 3)):
        spark.createDataFrame(part.sample(frac=1, random_state=k)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.createDataFrame(late).coalesce(1).write.parquet(str(tmp_path / "in/3"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    marks = str(tmp_path / "end")
    arrivals.end_of_input(spark, marks, None)
    closed = state.rate_flag(arrivals.with_end(stream, marks, "client", state.END), limit=5, window=3600.0)
    for end in (None, events.ts.max().to_pydatetime()):
        if end:
            arrivals.end_of_input(spark, marks, end)
        arrivals.drain(closed, str(tmp_path / "out"), str(tmp_path / "ck"), "append")
    got = {r.event_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = _flags(events, 5, 3600.0)
    assert got == want  # the last event too, the late one not
    batch = {r.event_id: r.outcome for r in state.rate_flag_batch(spark.createDataFrame(events), 5, 3600.0).collect()}
    assert batch == want


def test_sliding_counts_as_a_stream(spark, tmp_path):
    """The windows of a running stream with a late row that is dropped (two batches after the watermark passed it); the end marker closes the last ones."""
    at = lambda m: pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(minutes=m)
    for k, minutes in enumerate([[0, 5, 12, 70, 71], [200, 201], [205], [3]]):
        spark.createDataFrame(pd.DataFrame({"user_id": 1, "ts": [at(m) for m in minutes]})).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    marks = str(tmp_path / "end")
    arrivals.end_of_input(spark, marks, None)
    counts = arrivals.volume(arrivals.with_end(stream, marks, "user_id"), late="20 minutes", width="1 hour", slide="10 minutes", by="user_id")
    for end in (None, at(205).to_pydatetime()):
        if end:
            arrivals.end_of_input(spark, marks, end)
        arrivals.drain(counts, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.window_start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).filter("user_id is not null").collect()}
    kept = spark.createDataFrame(pd.DataFrame({"user_id": 1, "ts": [at(m) for m in (0, 5, 12, 70, 71, 200, 201, 205)]}))
    assert got == {(r.window_start, r.n) for r in arrivals.volume(kept, width="1 hour", slide="10 minutes", by="user_id").collect()}


def test_texts_new_over_all_history(spark, tmp_path):
    """Three batches, then the last one again under its id: nothing changes."""
    known = str(tmp_path / "known")
    schema = spark.createDataFrame([], "review_id long, review_text string, fingerprint string").schema
    write = arrivals.reject_repeats(known, schema)
    batches = [[(1, "One text"), (2, "other"), (3, "one  TEXT")], [(4, "other"), (5, "new")], [(6, "one text"), (7, "newest"), (8, "newest")]]
    read = lambda: sorted((r.review_text.lower(), r.batch_id) for r in spark.read.parquet(known).collect())
    for k, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "review_id long, review_text string"), k)
    first = read()
    assert [(t.replace("  ", " "), k) for t, k in first] == [("new", 1), ("newest", 2), ("one text", 0), ("other", 0)]
    for k in (2, 1):
        write(spark.createDataFrame(batches[k], "review_id long, review_text string"), k)
    assert read() == first


def test_decision_steps():
    assert state.next_state("pending", "approved", True) == "accepted"
    assert state.next_state("pending", "approved", False) == "needs author and reason"
    assert state.next_state("pending", "ingested", False) == "refused: pending cannot become ingested"
    assert state.next_state("approved", "ingested", False) == "accepted"


def test_folds_hold_every_class(spark):
    rows = [(f"text {i}", "rare" if i < 5 else "usual") for i in range(400)]
    got = models.with_folds(spark.createDataFrame(rows, ["text", "label"]), 5).groupBy("label", "fold").count().collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.label].append(r["count"])
    assert sorted(per["rare"]) == [1] * 5 and sorted(per["usual"]) == [79] * 5


def test_a_request_gets_all_it_asks_for(spark):
    stats = spark.createDataFrame([(i, f"p{i}", "c", "d", "v", "sight", "attraction", 10 + i, 4.0) for i in range(180)],
                                  "place_id long, place_name string, city string, district string, division string, category string, place_kind string, review_count long, avg_review_rating double")
    venue = stats.selectExpr("place_id", "'P-1' AS preference_id", "5L AS review_count")
    asks = spark.createDataFrame([("a", ["p-1"], None, None, None, None, 0, 150)], "request_id string, wanted array<string>, city string, division string, place_kind string, exclude_cities array<string>, min_reviews int, limit int")
    got = retrieval.recommend(asks, stats, venue).collect()
    assert len(got) == 150 and sorted(r["rank"] for r in got) == list(range(1, 151))


def test_days_prefer_the_first_place_s_district_then_city():
    rows = [(1, "A", "x"), (2, "B", "y"), (3, None, "x"), (4, "A", "z"), (5, "B", "y"), (6, "C", "x")]
    group = pd.DataFrame([("r", "g", 1, k, p, d, c, 2, 3) for k, (p, d, c) in enumerate(rows, 1)],
                         columns=["request_id", "region", "region_rank", "pos", "place_id", "district", "city", "region_days", "per_day"])
    got = fill_days(group)
    assert got[["region_day", "stop", "place_id"]].values.tolist() == [[1, 1, 1], [1, 2, 4], [1, 3, 3], [2, 1, 2], [2, 2, 5], [2, 3, 6]]
