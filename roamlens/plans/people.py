"""Statistics, trips, messages and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.operators import messages, planning, rollups, stats
from roamlens.plans.names import compared
from roamlens.plans.registry import query
from roamlens.plans.serving import stats as place_stats
from roamlens.plans.serving import venue
from roamlens.sources.adapters import Tables
from roamlens.streaming import arrivals, state


# ---- statistics ----------------------------------------------------------------------------
def rank_values(t: Tables):
    """Ratings and text lengths of two groups of reviews."""
    r = t.reviews.filter("detected_language = 'en' OR source = 'R'").selectExpr("CASE WHEN source = 'R' THEN 'a' ELSE 'b' END AS grp", "review_rating", "text_length")
    return r.select("grp", F.explode(F.array(
        F.struct(F.lit("rating").alias("metric"), F.col("review_rating").cast("double").alias("value")),
        F.struct(F.lit("length").alias("metric"), F.col("text_length").cast("double").alias("value")))).alias("x")).select("grp", "x.*")


query("stat_1_rank_tests", """
WITH v AS (SELECT CASE WHEN source = 'R' THEN 'a' ELSE 'b' END AS grp, 'rating' AS metric, review_rating::DOUBLE AS value FROM reviews WHERE detected_language = 'en' OR source = 'R'
  UNION ALL SELECT CASE WHEN source = 'R' THEN 'a' ELSE 'b' END, 'length', text_length::DOUBLE FROM reviews WHERE detected_language = 'en' OR source = 'R'),
k AS (SELECT metric, value, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb, count(*) AS t FROM v GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS mr FROM k),
s AS (SELECT metric, sum(na)::DOUBLE AS n1, sum(nb)::DOUBLE AS n2, sum(na * mr)::DOUBLE AS rs, sum(t::DOUBLE * t * t - t) AS ties FROM r GROUP BY 1)
SELECT metric, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round((rs - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS ranksums_z, rs - n1 * (n1 + 1) / 2 AS u_statistic,
  round((greatest(rs - n1 * (n1 + 1) / 2, n1 * n2 - (rs - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS u_z FROM s
""")(lambda t: stats.rank_tests(rank_values(t)).drop("ranksums_p", "u_p"))
query("stat_1_rank_test_p_values")(lambda t: stats.rank_tests(rank_values(t)))
query("stat_2_retention", """
WITH m AS (SELECT review_id, entity_type, lower(surface) AS concept, bool_or(surface = upper(surface)) AS o, bool_or(surface <> upper(surface)) AS t FROM mentions GROUP BY 1, 2, 3)
SELECT entity_type, count(*) FILTER (o) AS in_original, count(*) FILTER (t) AS in_translation, count(*) FILTER (o AND t) AS kept, count(*) FILTER (o AND NOT t) AS lost, count(*) FILTER (t AND NOT o) AS only_in_translation,
  round(avg(CASE WHEN o THEN t::INT::DOUBLE END), 4) AS retention FROM m GROUP BY 1
""")(lambda t: stats.retention(compared(t)))
query("stat_3_bootstrap_interval")(lambda t: stats.bootstrap_interval(compared(t)))


def sides(t: Tables):
    """Lost and missing places with a visibility level from the part's size."""
    levels = t.raw("part").selectExpr("lower(concat(p_name, ' ', p_brand)) AS concept", "p_size").groupBy("concept").agg(F.max("p_size").alias("s")).selectExpr("concept", "concat('V', s % 4) AS visibility")
    return stats.visibility_sides(compared(t), levels)


query("stat_4_visibility_sides", """
WITH m AS (SELECT review_id, entity_type, lower(surface) AS concept, bool_or(surface = upper(surface)) AS o, bool_or(surface <> upper(surface)) AS t FROM mentions WHERE entity_type = 'PLACE' GROUP BY 1, 2, 3),
l AS (SELECT lower(concat(p_name, ' ', p_brand)) AS concept, max(p_size) % 4 AS v FROM part GROUP BY 1)
SELECT CASE WHEN o THEN 'lost_in_translation' ELSE 'missing_from_lists' END AS side, count(*) FILTER (v < 2) AS little_known, count(v) AS rated FROM m LEFT JOIN l USING (concept) WHERE o <> t GROUP BY 1
""")(sides)


def tables_2x2(t: Tables):
    """Orders by priority and status against price, one table per customer segment pair."""
    return t.raw("orders").groupBy(F.col("o_orderpriority").alias("table_id")).agg(
        F.count_if(F.expr("o_orderstatus = 'F' AND o_totalprice > 250000")).alias("a"), F.count_if(F.expr("o_orderstatus = 'F' AND o_totalprice <= 250000")).alias("b"),
        F.count_if(F.expr("o_orderstatus <> 'F' AND o_totalprice > 250000")).alias("c"), F.count_if(F.expr("o_orderstatus <> 'F' AND o_totalprice <= 250000")).alias("d"))


query("stat_4_fisher_exact", """
WITH q AS (SELECT o_orderpriority AS table_id, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 250000) AS a, count(*) FILTER (o_orderstatus = 'F') AS r, count(*) FILTER (o_totalprice > 250000) AS k, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x FROM q),
p AS (SELECT table_id, a, x, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) AS l FROM x)
SELECT table_id, round(least(1.0, sum(CASE WHEN l <= s + 1e-7 THEN exp(l) ELSE 0 END)), 6) AS p_two_sided FROM (SELECT *, max(CASE WHEN x = a THEN l END) OVER (PARTITION BY table_id) AS s FROM p) GROUP BY 1
""")(lambda t: stats.fisher_exact(tables_2x2(t)))


def votes(t: Tables):
    """Three raters of the documents: quality, absence of toxicity, and length."""
    l = t.raw("labels").join(t.raw("documents").select("doc_id", "n_chars"), "doc_id")
    return l.select(F.col("doc_id").alias("pair_key"), F.explode(F.array(*[F.struct(F.lit(n).alias("annotator"), F.expr(e).cast("int").alias("label")) for n, e in (
        ("a", "quality"), ("b", "1 - toxic"), ("c", "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END"))])).alias("v")).select("pair_key", "v.*")


VOTES = """votes AS (SELECT doc_id AS k, quality AS a, 1 - toxic AS b, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS c FROM labels JOIN documents USING (doc_id))"""
BAND = "CASE WHEN k < 0 THEN 'poor (below chance)' WHEN k <= 0.2 THEN 'slight' WHEN k <= 0.4 THEN 'fair' WHEN k <= 0.6 THEN 'moderate' WHEN k <= 0.8 THEN 'substantial' ELSE 'almost perfect' END"
query("stat_5_cohen_kappa", f"""WITH {VOTES}, p AS (SELECT 'a' AS x, 'b' AS y, a AS u, b AS v FROM votes UNION ALL SELECT 'a', 'c', a, c FROM votes UNION ALL SELECT 'b', 'c', b, c FROM votes),
s AS (SELECT x, y, count(*) AS n, avg((u = v)::INT) AS po, avg(u) * avg(v) + (1 - avg(u)) * (1 - avg(v)) AS pe FROM p GROUP BY 1, 2), t AS (SELECT *, (po - pe) / (1 - pe) AS k FROM s)
SELECT x AS annotator_a, y AS annotator_b, n, round(po, 6) AS raw_agreement, round(k, 6) AS cohen_kappa, {BAND} AS interpretation FROM t""")(lambda t: stats.cohen_kappa(votes(t)))
query("stat_6_fleiss_kappa", f"""WITH {VOTES}, i AS (SELECT a + b + c AS y FROM votes), s AS (SELECT count(*) AS n, avg((y * y + (3 - y) * (3 - y) - 3) / 6.0::DOUBLE) AS pb, sum(y) / (3.0::DOUBLE * count(*)) AS p1 FROM i),
t AS (SELECT n, (pb - (p1 * p1 + (1 - p1) * (1 - p1))) / (1 - (p1 * p1 + (1 - p1) * (1 - p1))) AS k FROM s) SELECT n AS n_items, CAST(3 AS BIGINT) AS raters, round(k, 6) AS fleiss_kappa, {BAND} AS interpretation FROM t""")(lambda t: stats.fleiss_kappa(votes(t)))
query("stat_7_consensus", f"""WITH {VOTES} SELECT k AS pair_key, a + b + c AS yes, 3 - a - b - c AS "no", CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END AS consensus, a + b + c BETWEEN 1 AND 2 AS disagreement FROM votes""")(
    lambda t: stats.consensus(votes(t)).select("pair_key", F.col("yes").cast("int").alias("yes"), F.col("no").cast("int").alias("no"), "consensus", "disagreement"))
query("stat_7_binary_scores", """
WITH p AS (SELECT source, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, quality AS t FROM labels JOIN documents USING (doc_id)),
s AS (SELECT source, count(*) AS n, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn, count(*) FILTER (p = 0 AND t = 0) AS tn FROM p GROUP BY 1),
m AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS rc FROM s)
SELECT source, n, tp, fp, fn, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / nullif(pr + rc, 0), 6) AS f1, round((tp + tn)::DOUBLE / n, 6) AS accuracy FROM m
""")(lambda t: stats.binary_scores(t.raw("labels").join(t.raw("documents"), "doc_id").selectExpr("source", "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted", "quality AS truth"), ["source"]))
query("stat_8_shares", """
SELECT source, count(*) AS n, count(*) FILTER (review_rating >= 4) AS n_true, round(avg((review_rating >= 4)::INT), 4) AS share FROM reviews GROUP BY 1
""")(lambda t: stats.share(t.reviews, F.col("review_rating") >= 4, ["source"]))


# ---- collection plan ---------------------------------------------------------------------------
def plan_places(t: Tables):
    reviews = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("place_id")).agg(F.count("*").alias("n"))
    return t.places.join(reviews, "place_id").selectExpr("place_id", "division", "n AS review_count", "n div 3 + place_id % 50 AS existing")


def plan_quotas(t: Tables):
    return t.raw("region").selectExpr("r_name AS division", "r_regionkey * 400 + 150 AS quota")


query("agg_23_collection_plan")(lambda t: rollups.water_level(plan_places(t), plan_quotas(t)).withColumn(
    "tier", rollups.collection_tier(F.ceil(F.col("target_new") * 1.2), F.col("review_count"))))
query("agg_23_collection_totals", """
SELECT division, least(quota, CAST(sum(greatest(0, n - (n // 3 + place_id % 50))) AS BIGINT)) AS total FROM places JOIN (SELECT l_suppkey AS place_id, count(*) AS n FROM lineitem GROUP BY 1) USING (place_id)
JOIN (SELECT r_name AS division, r_regionkey * 400 + 150 AS quota FROM region) USING (division) GROUP BY division, quota
""")(lambda t: rollups.water_level(plan_places(t), plan_quotas(t)).groupBy("division").agg(F.sum("target_new").alias("total")))


# ---- trips ---------------------------------------------------------------------------------------
def trips(t: Tables):
    """A trip wish per customer: days, pace, up to two preferences, and for some a city or division."""
    prefs = "array('SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO', 'ECONOMY')"
    c = t.raw("customer").join(t.geography, F.expr("c_nationkey = n_nationkey"))
    return c.selectExpr(
        "CAST(c_custkey AS string) AS request_id", "CAST(c_custkey % 7 + 1 AS int) AS days", "element_at(array('relaxed', 'standard', 'packed'), CAST(c_custkey % 3 + 1 AS int)) AS pace",
        f"CASE WHEN c_mktsegment = 'BUILDING' THEN array() ELSE array(concat('P-', {prefs}[c_custkey % 6]), concat('P-', {prefs}[c_nationkey % 6])) END AS wanted",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN concat(district, '/1') END AS city", "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN division END AS division",
        "CAST(array() AS array<string>) AS exclude_cities", "1 AS min_reviews", "CAST(NULL AS int) AS max_regions")


def planned(t: Tables, build) -> DataFrame:
    """``build`` of (wishes, their ranked regions), made once for equal wishes and given to each customer."""
    wishes, members = planning.alike(trips(t))
    return planning.for_each(build(wishes, planning.trip_regions(wishes, place_stats(t), venue(t))), members)


def ranked(t: Tables):
    return planned(t, lambda wishes, r: r)


def stops(r: DataFrame) -> DataFrame:
    return planning.day_stops(r, planning.allocate_days(r))


query("ret_10_trip_regions")(ranked)
query("ret_10_region_scores_add_up", """
SELECT CAST(c_custkey AS VARCHAR) AS request_id, true AS has_plan FROM customer JOIN geo ON c_nationkey = n_nationkey WHERE c_mktsegment = 'AUTOMOBILE'
  AND EXISTS (SELECT 1 FROM venue v JOIN places p ON p.place_id = v.place_id WHERE p.place_kind = 'attraction' AND p.division = geo.division AND v.preference_id IN (
    concat('P-', (['SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO', 'ECONOMY'])[c_custkey % 6 + 1]), concat('P-', (['SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO', 'ECONOMY'])[c_nationkey % 6 + 1])))
""")(lambda t: ranked(t).join(t.raw("customer").filter("c_mktsegment = 'AUTOMOBILE'").selectExpr("CAST(c_custkey AS string) AS request_id"), "request_id", "left_semi").select(
    "request_id", F.lit(True).alias("has_plan")).distinct())
query("ret_11_day_allocation")(lambda t: planned(t, lambda wishes, r: planning.allocate_days(r)))
query("ret_11_days_add_up", """
SELECT CAST(c_custkey AS VARCHAR) AS request_id, CAST(c_custkey % 7 + 1 AS BIGINT) AS days FROM customer WHERE c_mktsegment = 'BUILDING'
""")(lambda t: planned(t, lambda wishes, r: planning.allocate_days(r)).groupBy("request_id").agg((F.sum("region_days") + F.max("spare_days")).alias("days")).join(
    t.raw("customer").filter("c_mktsegment = 'BUILDING'").selectExpr("CAST(c_custkey AS string) AS request_id"), "request_id", "left_semi"))
query("ret_12_day_stops")(lambda t: planned(t, lambda wishes, r: stops(r)))
query("ret_12_day_moves")(lambda t: planned(t, lambda wishes, r: planning.day_moves(stops(r))))
query("ret_12_stays")(lambda t: planned(t, lambda wishes, r: planning.stays(planning.day_moves(stops(r)), place_stats(t))))
query("ret_12_trip_summary")(lambda t: planned(t, lambda wishes, r: (lambda s: planning.trip_summary(wishes, s, planning.day_moves(s), venue(t)))(stops(r))))


# ---- messages -------------------------------------------------------------------------------------
def message_rows(t: Tables):
    """User turns, some with a question about a supplier, a city or a trip put before them."""
    return t.raw("conversations").filter("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS message_id",
        "CASE conv_id % 7 WHEN 0 THEN concat('Compare Supplier#', lpad(conv_id % 10, 9, '0'), ' and supplier#', lpad(turn % 10, 9, '0'), '. ', text) WHEN 1 THEN 'Hello there' WHEN 2 THEN concat('Plan a ', turn, ' day relaxed trip to NATION_', conv_id % 25, '/1') "
        "WHEN 3 THEN concat('any large rooms? ', text) WHEN 4 THEN concat('reviews of supplier#', lpad(conv_id % 10, 9, '0')) ELSE text END AS message")


MESSAGES = """message_rows AS MATERIALIZED (SELECT conv_id * 1000 + turn AS message_id, lower(CASE conv_id % 7 WHEN 0 THEN concat('Compare Supplier#', lpad(CAST(conv_id % 10 AS VARCHAR), 9, '0'), ' and supplier#', lpad(CAST(turn % 10 AS VARCHAR), 9, '0'), '. ', text)
  WHEN 1 THEN 'Hello there' WHEN 2 THEN concat('Plan a ', turn, ' day relaxed trip to NATION_', conv_id % 25, '/1') WHEN 3 THEN concat('any large rooms? ', text) WHEN 4 THEN concat('reviews of supplier#', lpad(CAST(conv_id % 10 AS VARCHAR), 9, '0')) ELSE text END) AS message
  FROM conversations WHERE role = 'user')"""


def cities(t: Tables):
    return rollups.city_stats(t.places, t.reviews)


query("ret_13_place_matches", f"""WITH {MESSAGES}
SELECT message_id, place_id, CAST(CASE WHEN contains(message, lower(place_name)) THEN 100 ELSE 1 END AS BIGINT) AS score FROM message_rows JOIN places ON contains(message, lower(place_name)) OR list_contains(regexp_extract_all(message, '[a-z'']+'), 'supplier')
""")(lambda t: messages.place_matches(message_rows(t), place_stats(t)))
query("ret_13_city_matches", f"""WITH {MESSAGES}
SELECT message_id, city, min(district) AS district FROM message_rows JOIN city_stats ON contains(message, lower(city)) GROUP BY 1, 2
""")(lambda t: messages.city_matches(message_rows(t), cities(t)))
query("ret_13_message_tags")(lambda t: messages.tag(message_rows(t), place_stats(t), cities(t), t.preferences))
query("ret_4_containment_pairs", """
SELECT doc_id AS id, item_id AS term_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))
""")(lambda t: messages.containment_pairs(t.raw("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")),
                                          t.raw("benchmark").select(F.col("item_id").alias("term_id"), F.lower("text").alias("term"))))


# ---- streams ------------------------------------------------------------------------------------------
def _scratch(t: Tables) -> str:
    """A folder for stream output: beside the shared checkpoint folder, or temporary in local runs."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared}/stream-{uuid.uuid4().hex}"
    if not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="roamlens-stream-")


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream of files, with a watermark-ready time."""
    return t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    base = _scratch(t)
    arrivals.drain(stream, f"{base}/out", f"{base}/ck", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _finished(t: Tables, build, key: str, value: str | None = None, mode: str = "append") -> DataFrame:
    """All rows of a stream over the finished events table: it is drained, closed by an end marker and drained to the end."""
    base = _scratch(t)
    marks = f"{base}/end"
    arrivals.end_of_input(t.spark, marks, None)
    stream = build(lambda events: arrivals.with_end(events, marks, key, value))
    arrivals.drain(stream, f"{base}/out", f"{base}/ck", mode)
    last = t.raw("events").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).first().t
    arrivals.end_of_input(t.spark, marks, last)
    arrivals.drain(stream, f"{base}/out", f"{base}/ck", mode)
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _daily(df: DataFrame) -> DataFrame:
    return arrivals.volume(df, late="6 hours", width="1 day", by="event_type")


query("stream_1_daily_volume", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")(lambda t: _daily(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.to_date("window_start").alias("day"), "event_type", "n"))
query("stream_1_daily_volume_streamed", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1, 2
""")(lambda t: _drained(t, _daily(event_stream(t))).select(F.to_date("window_start").alias("day"), "event_type", "n"))
query("stream_2_first_arrivals", """
SELECT DISTINCT sha256(lower(concat(event_type, ' ', user_id))) AS fingerprint FROM events
""")(lambda t: _drained(t, arrivals.first_arrivals(event_stream(t).withColumn("review_text", F.expr("concat(event_type, '  ', user_id)")), late="40 days").select("fingerprint")))
SLIDING = """
SELECT user_id, strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(10 * k AS INTEGER)) AS w FROM events, (SELECT unnest(range(0, 6)) AS k)) GROUP BY 1, 2
"""


def _sliding(df: DataFrame) -> DataFrame:
    return arrivals.volume(df, late="20 minutes", width="1 hour", slide="10 minutes", by="user_id")


def _counts(df: DataFrame) -> DataFrame:
    return df.filter("user_id IS NOT NULL").select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


query("stream_5_sliding_counts", SLIDING)(lambda t: _counts(_sliding(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")))))
query("stream_5_sliding_counts_streamed", SLIDING)(lambda t: _counts(_finished(
    t, lambda close: _sliding(close(event_stream(t).select("user_id", "ts"))), "user_id")))


def _new_texts(t: Tables) -> DataFrame:
    """Texts of the events never seen before, over all history, batch by batch."""
    base = _scratch(t)
    stream = event_stream(t).selectExpr("event_id", "concat(event_type, '  ', user_id) AS review_text")
    known = stream.withColumn("fingerprint", F.lit("")).schema
    arrivals.run_once(stream, arrivals.reject_repeats(f"{base}/known", known), f"{base}/ck")
    return arrivals.read_batches(t.spark, f"{base}/known", known)


query("stream_2_new_over_history", """
SELECT DISTINCT sha256(lower(concat(event_type, ' ', user_id))) AS fingerprint FROM events
""")(lambda t: _new_texts(t).select("fingerprint"))


def decisions(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "CAST(user_id AS string) AS submission_id", "event_id AS seq", "CAST(ts AS timestamp) AS ts",
        "CASE event_type WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'ingested' ELSE 'approved' END AS state",
        "CASE WHEN event_id % 5 = 0 THEN '' ELSE 'officer' END AS decided_by", "props AS reason")


query("stream_3_decision_states", f"""
WITH RECURSIVE d AS (SELECT CAST(user_id AS VARCHAR) AS submission_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'ingested' ELSE 'approved' END AS state,
    event_id % 5 <> 0 AND trim(coalesce(props, '')) <> '' AS explained, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT submission_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS from_state, CAST(NULL AS VARCHAR) AS to_state, CAST(NULL AS VARCHAR) AS outcome, 'pending' AS now, CAST(0 AS BIGINT) AS rn FROM d WHERE rn = 1
  UNION ALL SELECT submission_id, seq, was, state, o, CASE WHEN o = 'accepted' THEN state ELSE was END, rn FROM (
    SELECT d.submission_id, d.seq, w.now AS was, d.state, d.rn, CASE WHEN d.state <> 'ingested' AND NOT explained THEN 'needs author and reason'
      WHEN (w.now = 'pending' AND d.state IN ('approved', 'rejected')) OR (w.now = 'approved' AND d.state IN ('approved', 'rejected', 'ingested')) OR (w.now = 'rejected' AND d.state IN ('approved', 'rejected')) THEN 'accepted'
      ELSE concat('refused: ', w.now, ' cannot become ', d.state) END AS o
    FROM w JOIN d ON d.submission_id = w.submission_id AND d.rn = w.rn + 1))
SELECT submission_id, seq, from_state, to_state, outcome FROM w WHERE rn > 0
""")(lambda t: _finished(t, lambda close: state.decide(close(decisions(event_stream(t)))), "submission_id", state.END))


def clients(df: DataFrame) -> DataFrame:
    return df.selectExpr("CAST(user_id AS string) AS client", "event_id", "CAST(ts AS timestamp) AS ts")


def flags_sql(where: str) -> str:
    """At most two accepted events of a client in a day, walked event by event."""
    return f"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {where}),
w AS (SELECT client, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS moment, CAST(NULL AS VARCHAR) AS outcome, CAST([] AS DOUBLE[]) AS recent, CAST(0 AS BIGINT) AS rn FROM e WHERE rn = 1
  UNION ALL SELECT client, event_id, moment, CASE WHEN len(r) < 2 THEN 'accepted' ELSE 'refused' END, CASE WHEN len(r) < 2 THEN list_append(r, moment) ELSE r END, rn FROM (
    SELECT e.client, e.event_id, e.moment, e.rn, list_filter(w.recent, lambda x: e.moment - x < 86400.0) AS r FROM w JOIN e ON e.client = w.client AND e.rn = w.rn + 1))
SELECT client, event_id, moment AS "at", outcome FROM w WHERE rn > 0"""


query("stream_4_rate_flag", flags_sql("true"))(lambda t: _finished(t, lambda close: state.rate_flag(close(clients(event_stream(t))), limit=2, window=86400.0), "client", state.END))
query("stream_4_rate_flag_batch", flags_sql("true"))(lambda t: state.rate_flag_batch(clients(t.raw("events")), limit=2, window=86400.0))


def _ingested(t: Tables) -> DataFrame:
    base = _scratch(t)
    src = t.spark.readStream.schema(t.raw("documents").schema).parquet(f"{t.folder}/documents.parquet*").selectExpr(
        "CAST(doc_id AS string) AS review_id", "source AS place_name", "text AS review_text", "CASE WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS status")
    arrivals.run_once(src, arrivals.ingest(f"{base}/reviews"), f"{base}/ck")
    return t.spark.read.parquet(f"{base}/reviews").drop("batch_id")


query("stream_6_ingest", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS place_name FROM documents WHERE doc_id % 3 <> 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 10
""")(lambda t: _ingested(t).select("review_id", "place_name"))
