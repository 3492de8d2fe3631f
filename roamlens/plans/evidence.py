"""Mentions, entities, little-known places, links, coverage and audiences."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.operators import gems, joins, resolution, retrieval, rollups
from roamlens.plans.frames_sql import FRAMES, WEIGHTS, score_sql
from roamlens.plans.registry import query
from roamlens.session import cut_lineage
from roamlens.sources.adapters import Tables

STOP = ["the", "and", "of"]


def evidence(t: Tables):
    return joins.mention_evidence(t.linked_mentions, t.entities, t.host_reviews)


def pairs(t: Tables):
    return gems.entity_reviews(t.linked_mentions)


def visible(t: Tables):
    return gems.raise_by_list(gems.visibility(t.lookups))


def word_weights(t: Tables):
    w = t.raw("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.withColumn("weight", (F.length("word") % 5 - 2).cast("double"))


def host_texts(t: Tables):
    return t.host_reviews.withColumn("review_text", F.concat_ws(" ", "source", "place_name", "detected_language"))


def recency(t: Tables):
    return gems.term_recency(pairs(t), t.host_reviews)


def sentiment(t: Tables):
    return gems.term_sentiment(t.linked_mentions, word_weights(t))


def distinct(t: Tables):
    return gems.term_distinct(t.linked_mentions, host_texts(t), STOP)


def scored(t: Tables):
    p = cut_lineage(pairs(t))  # two terms count them
    return gems.score(gems.candidates(t.entities, p), visible(t), gems.term_recency(p, t.host_reviews), sentiment(t), distinct(t))


def log(t: Tables):
    e = t.raw("events").filter("event_type IN ('signup', 'error', 'click')")
    p = t.raw("part").filter("p_type IN ('MEDIUM', 'LARGE')").select("p_partkey", "p_name", "p_brand")
    return e.join(p, F.expr("p_partkey = user_id")).selectExpr(
        "event_id AS log_order", "date_format(date_trunc('hour', ts), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS decided_at_utc",
        "concat('PLACE/', lower(concat(p_name, ' ', p_brand))) AS entity_id",
        "CASE event_type WHEN 'signup' THEN 'verified' WHEN 'error' THEN 'rejected' ELSE 'sensitive' END AS state",
        "concat('officer ', user_id % 3) AS decided_by", "props AS reason")


def queue_rows(t: Tables):
    return gems.queue(scored(t), gems.current_states(log(t)), evidence(t))


def attributes(t: Tables):
    return rollups.place_attributes(t.linked_mentions, t.entities, t.host_reviews)


def link_reviews(t: Tables):
    """Host reviews where every third one is about a place that is itself mentioned elsewhere."""
    p = t.raw("part").select("p_partkey", "p_name", "p_brand")
    h = t.host_reviews.join(p, F.expr("p_partkey = CAST(review_id AS bigint) % 100"), "left")
    return h.selectExpr("review_id", "CASE WHEN CAST(review_id AS bigint) % 3 = 0 THEN lower(concat(p_name, ' ', p_brand)) ELSE lower(place_name) END AS place_name")


def links(t: Tables):
    return rollups.place_links(t.linked_mentions, t.entities, link_reviews(t))


# ---- mentions and entities --------------------------------------------------------------------
EV = "mention_id, entity_id, canonical_name, entity_type, surface, sentence, match_kind, language, extractor, review_id, found_in_place, found_in_district, found_in_division, review_rating, review_date"
query("join_3_mention_evidence", f"SELECT {EV} FROM evidence")(evidence)
query("join_17_attach_entities", """
SELECT m.mention_id, m.entity_type, m.surface, v.entity_id FROM mentions m LEFT JOIN (SELECT * FROM variants WHERE mentions > 20) v ON v.surface = m.surface AND v.entity_type = m.entity_type
""")(lambda t: joins.attach_entities(t.mentions.select("mention_id", "entity_type", "surface"), t.variants.filter("mentions > 20")))
query("join_17_unresolved", """
SELECT m.entity_type, count(*) AS n_mentions, count(*) FILTER (v.entity_id IS NULL) AS n_unresolved FROM mentions m LEFT JOIN (SELECT * FROM variants WHERE mentions > 20) v
  ON v.surface = m.surface AND v.entity_type = m.entity_type GROUP BY 1
""")(lambda t: joins.unresolved(t.mentions, t.variants.filter("mentions > 20")))
query("agg_13_entity_evidence", """
SELECT e.entity_id, e.canonical_name, e.entity_type, e.n_variants, count(v.mention_id) AS n_mentions, count(DISTINCT v.review_id) AS n_reviews,
  count(DISTINCT v.found_in_place) AS n_found_in_places, count(DISTINCT v.found_in_division) AS n_divisions, round(sum(r * m) / sum(CASE WHEN r IS NOT NULL THEN m END), 3) AS avg_rating_of_host_reviews
FROM entities e LEFT JOIN (SELECT *, review_rating AS r, 1 AS m FROM evidence) v ON v.entity_id = e.entity_id GROUP BY 1, 2, 3, 4
""")(lambda t: rollups.entity_evidence(t.entities, evidence(t)))
query("ret_3_entity_evidence_list", """
SELECT entity_id, rank, mention_id, surface, review_id, found_in_place, review_date FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY review_date DESC NULLS LAST, mention_id) AS INTEGER) AS rank FROM evidence) WHERE rank <= 20
""")(lambda t: retrieval.evidence_list(evidence(t)))
query("ret_3_entity_found_in", """
SELECT entity_id, found_in_place AS place_name, count(DISTINCT review_id) AS n_reviews FROM evidence WHERE found_in_place IS NOT NULL GROUP BY 1, 2
""")(lambda t: retrieval.found_in(evidence(t)))
EVIDENCE_COUNTS = """counted AS (SELECT e.entity_id, e.canonical_name, e.entity_type, count(v.mention_id) AS n_mentions, count(DISTINCT v.review_id) AS n_reviews,
  coalesce(bool_or(v.found_in_division = 'ASIA'), false) AS here FROM entities e LEFT JOIN evidence v ON v.entity_id = e.entity_id GROUP BY 1, 2, 3)"""
query("ret_1_entities_page", f"""WITH {EVIDENCE_COUNTS}, hit AS (SELECT * FROM counted WHERE n_reviews >= 2 AND upper(entity_type) = 'FOOD' AND here)
SELECT entity_id, canonical_name, entity_type, n_reviews, n_mentions, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY n_reviews DESC, n_mentions DESC, canonical_name LIMIT 30 OFFSET 5
""")(lambda t: retrieval.entity_page(t.entities, evidence(t), entity_type="food", min_reviews=2, division="ASIA", limit=30, offset=5).select(
    "entity_id", "canonical_name", "entity_type", "n_reviews", "n_mentions", "total"))
query("ret_1_mentions_page", """
WITH hit AS (SELECT * FROM evidence WHERE lower(entity_type) = 'place' AND lower(found_in_place) LIKE '%1 mach%')
SELECT mention_id, entity_id, entity_type, surface, review_id, found_in_place, review_date, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY mention_id LIMIT 40 OFFSET 10
""")(lambda t: retrieval.mention_page(evidence(t), entity_type="Place", found_in_place="1 MACH", limit=40, offset=10).select(
    "mention_id", "entity_id", "entity_type", "surface", "review_id", "found_in_place", "review_date", "total"))
query("res_7_merge_kinds", """
SELECT entity_id, count(*) AS n_variants, count(DISTINCT lower(surface)) AS n_spellings, CASE WHEN count(DISTINCT lower(surface)) > 1 THEN 'substantive' ELSE 'case only' END AS kind FROM variants GROUP BY 1 HAVING count(*) > 1
""")(lambda t: resolution.merge_kinds(t.variants))

# ---- visibility and score ------------------------------------------------------------------------
query("gem_1_visibility", "SELECT entity_id, visibility, visibility_reason FROM visible_lookup")(
    lambda t: gems.visibility(t.lookups).select("entity_id", "visibility", "visibility_reason"))
query("gem_2_raise_by_list", "SELECT entity_id, visibility, visibility_reason FROM visible")(
    lambda t: visible(t).select("entity_id", "visibility", "visibility_reason"))
query("gem_3_candidates", "SELECT * FROM gem_candidates")(lambda t: gems.candidates(t.entities, pairs(t)))
query("gem_4_5_count_terms", """
SELECT entity_id, term_mentions, term_hidden FROM gem_terms
""")(lambda t: gems.candidates(t.entities, pairs(t)).join(visible(t).select("entity_id", "visibility"), "entity_id", "left").select(
    "entity_id", gems.term_mentions(F.col("n_reviews")).alias("term_mentions"), gems.term_hidden(F.col("visibility")).alias("term_hidden")))
query("gem_6_recency", "SELECT entity_id, round(term_recency, 6) AS term_recency, n_sources, n_years FROM recency")(
    lambda t: recency(t).withColumn("term_recency", F.round("term_recency", 6)))
query("gem_7_sentiment", "SELECT entity_id, round(term_sentiment, 6) AS term_sentiment, n_sentiment_sentences FROM sentiment")(
    lambda t: sentiment(t).withColumn("term_sentiment", F.round("term_sentiment", 6)))
query("gem_8_distinct", "SELECT entity_id, round(term_distinct, 6) AS term_distinct FROM distinct_terms")(
    lambda t: distinct(t).withColumn("term_distinct", F.round("term_distinct", 6)))
query("gem_9_score", "SELECT * FROM scored_gems")(scored)
query("gem_9_ablations", "WITH rounded_terms AS MATERIALIZED (SELECT * FROM scored_gems)\n" + "\nUNION ALL ".join(
    f"SELECT entity_id, '{n or 'none'}' AS ablated, {score_sql(n)} AS gem_score FROM rounded_terms"
    for n in [""] + [t for t, _ in WEIGHTS]))(lambda t: gems.ablations(scored(t)))
query("gem_10_term_spread", "WITH s AS MATERIALIZED (SELECT * FROM scored_gems), terms_long AS (" + " UNION ALL ".join(
    f"SELECT 'term_{t}' AS term, term_{t} AS value FROM s" for t, _ in WEIGHTS) + """)
SELECT term, count(*) AS n, count(DISTINCT value) AS n_values, round(stddev_samp(value), 6) AS sd,
  CASE WHEN count(*) < 3 THEN 'too few' WHEN count(DISTINCT value) = 1 THEN 'constant' WHEN round(stddev_samp(value), 6) < 0.05 THEN 'little spread' ELSE 'ok' END AS note
FROM terms_long WHERE value IS NOT NULL GROUP BY 1""")(lambda t: gems.term_spread(scored(t)))
query("gem_10_outranked", """
SELECT count(*) FILTER (already_official) AS n_official, max(gem_score) FILTER (already_official) AS best_official,
  count(*) FILTER (NOT already_official AND gem_score < (SELECT max(gem_score) FROM scored_gems WHERE already_official)) AS n_outranked FROM scored_gems
""")(lambda t: gems.outranked(scored(t)))
query("gem_11_current_states", "SELECT * FROM states")(lambda t: gems.current_states(log(t)))


def proposals(t: Tables):
    return t.raw("events").selectExpr(
        "event_id", "CASE WHEN user_id % 5 = 0 THEN concat('PLACE/x', user_id) ELSE concat('E', user_id) END AS entity_id",
        "CASE event_type WHEN 'signup' THEN ' Verified' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'maybe' WHEN 'view' THEN 'candidate' ELSE 'SENSITIVE' END AS state",
        "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'officer' END AS decided_by", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS reason")


query("gem_12_validate_decisions", """
SELECT event_id, entity_id, decided_by, reason, state, CASE WHEN state NOT IN ('candidate', 'verified', 'rejected', 'sensitive') THEN 'unknown state' WHEN state = 'candidate' THEN 'not a decision'
  WHEN trim(decided_by) = '' THEN 'no author' WHEN trim(coalesce(reason, '')) = '' THEN 'no reason' WHEN user_id % 5 = 0 THEN 'unknown entity' ELSE 'accepted' END AS outcome
FROM (SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN concat('PLACE/x', user_id) ELSE concat('E', user_id) END AS entity_id,
  CASE event_type WHEN 'signup' THEN 'verified' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'maybe' WHEN 'view' THEN 'candidate' ELSE 'sensitive' END AS state,
  CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'officer' END AS decided_by, CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS reason FROM events)
""")(lambda t: gems.validate_decisions(proposals(t), t.raw("events").selectExpr("concat('E', user_id) AS entity_id").distinct()))
query("gem_13_queue", "SELECT * FROM queue_rows")(queue_rows)
query("gem_14_register", "SELECT entity_id, state FROM queue_rows WHERE state <> 'rejected'")(
    lambda t: gems.register(queue_rows(t)).select("entity_id", "state"))
query("gem_14_publishable", "SELECT entity_id, state FROM queue_rows WHERE state = 'verified'")(
    lambda t: gems.publishable(queue_rows(t)).select("entity_id", "state"))
FRESH_SQL = """fresh AS (SELECT entity_id, min(review_date) AS first_evidence_date, max(review_date) AS last_evidence_date, CAST(year(max(review_date)) AS INTEGER) AS last_evidence_year,
  count(DISTINCT CASE WHEN review_date >= since THEN review_id END) AS n_recent_reviews, any_value(since) AS recent_since FROM entity_reviews JOIN host_reviews USING (review_id),
  (SELECT CAST(max(review_date) - INTERVAL 36 MONTH AS DATE) AS since FROM host_reviews) GROUP BY 1)"""


def fresh(t: Tables):
    return gems.freshness(pairs(t), t.host_reviews)


query("gem_15_freshness", f"WITH {FRESH_SQL} SELECT * FROM fresh")(fresh)
query("gem_16_gem_view", f"""WITH {FRESH_SQL}
SELECT g.entity_id, g.gem_score, g.visibility, first_evidence_date, last_evidence_date, last_evidence_year, coalesce(n_recent_reviews, 0) AS n_recent_reviews, recent_since,
  CASE WHEN coalesce(n_recent_reviews, 0) > 0 THEN 'recent' ELSE 'old' END AS freshness, CASE WHEN coalesce(n_recent_reviews, 0) = 0 THEN 1 ELSE 0 END AS needs_recent_confirmation
FROM scored_gems g LEFT JOIN fresh USING (entity_id)
""")(lambda t: gems.with_freshness(scored(t).select("entity_id", "gem_score", "visibility"), fresh(t)))


def built_gems(t: Tables):
    return joins.gems_build(scored(t), visible(t), queue_rows(t), t.linked_mentions, t.host_reviews, t.host_geography.select("place_name", "lat", "lng"))


query("join_6_gems_build", """
SELECT g.entity_id, g.gem_score, g.visibility, q.state, CAST(q.publishable AS INTEGER) AS publishable, q.decided_by, CASE WHEN borrow THEN h.lat ELSE v.lat END AS lat, CASE WHEN borrow THEN h.lng ELSE v.lng END AS lng,
  CASE WHEN borrow THEN 'near_host_place' WHEN v.lat IS NOT NULL THEN 'lookup' END AS coord_source, CASE WHEN borrow THEN h.place_name END AS near_place, v.maps_place,
  CAST(row_number() OVER (ORDER BY g.gem_score DESC NULLS LAST, g.entity_id) AS BIGINT) AS gem_rank
FROM scored_gems g LEFT JOIN visible v USING (entity_id) LEFT JOIN queue_rows q USING (entity_id) LEFT JOIN (SELECT entity_id, place_name, lat, lng FROM (
  SELECT entity_id, h.place_name, p.lat, p.lng, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, h.place_name) AS rn FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id
  JOIN host_geography p ON p.place_name = h.place_name GROUP BY 1, 2, 3, 4) WHERE rn = 1) h USING (entity_id), LATERAL (SELECT v.lat IS NULL AND g.visibility = 'V0' AND h.place_name IS NOT NULL AS borrow)
""")(lambda t: joins.gem_ranks(built_gems(t).select(
    "entity_id", "gem_score", "visibility", "state", "publishable", "decided_by", "lat", "lng", "coord_source", "near_place", "maps_place")))
query("ret_1_gems_page", """
SELECT entity_id, gem_score, visibility, state, (SELECT count(*) FROM queue_rows WHERE visibility IN ('V0', 'V1') AND divisions ILIKE '%asia%' AND gem_score >= 0.3) AS total FROM queue_rows
WHERE visibility IN ('V0', 'V1') AND divisions ILIKE '%asia%' AND gem_score >= 0.3 ORDER BY gem_score DESC, entity_id LIMIT 20
""")(lambda t: retrieval.page(
    queue_rows(t).withColumn("divisions", F.split("divisions", r"\|")), retrieval.filter_gems(t.entities, ["v0", "V1"], "Asia", min_score=0.3),
    [F.desc("gem_score"), F.asc("entity_id")], 20).select("entity_id", "gem_score", "visibility", "state", "total"))

# ---- attributes, specialities, links ----------------------------------------------------------------
query("agg_14_place_attributes", "SELECT * FROM attributes")(attributes)
query("agg_15_local_specialities", "SELECT * FROM specialities")(lambda t: rollups.local_specialities(attributes(t)))
query("agg_15_specialities_by_a_tenth", FRAMES["specialities"].replace(">= 0.6", ">= 0.1"))(
    lambda t: rollups.local_specialities(attributes(t), min_share=0.1))
query("agg_15_speciality_places", """
SELECT a.entity_id, a.district, a.place_name, a.n_reviews, s.name FROM attributes a JOIN specialities s ON s.entity_id = a.entity_id AND s.district = a.district
""")(lambda t: rollups.speciality_places(rollups.local_specialities(attributes(t)), attributes(t)))
query("ret_9_attribute_cards", """
SELECT place_name, entity_type, entity_id, name, n_reviews, n_recent_reviews, entity_type IN ('ACCESS', 'TIP') AND n_recent_reviews = 0 AS stale FROM attributes
""")(lambda t: retrieval.attribute_cards(attributes(t)))
query("ret_3_offers", """
SELECT a.entity_id, a.name, entity_type, place_name, a.district, n_reviews, last_year, n_recent_reviews, a.example_sentence, s.district AS speciality_of FROM attributes a LEFT JOIN specialities s ON s.entity_id = a.entity_id
WHERE entity_type IN ('FOOD', 'ACTIVITY', 'ACCESS')
""")(lambda t: retrieval.offers(attributes(t), rollups.local_specialities(attributes(t))))
query("agg_16_place_links", "SELECT * FROM links")(links)
query("agg_17_hubs", """
SELECT place, count(*) AS links, CAST(sum(n_reviews) AS BIGINT) AS reviews FROM (SELECT place_a AS place, n_reviews FROM links UNION ALL SELECT place_b, n_reviews FROM links) GROUP BY 1
""")(lambda t: rollups.hubs(links(t)))
query("agg_17_lesser_known_links", """
WITH lesser AS (SELECT name, min(visibility) AS v FROM visible WHERE visibility IN ('V0', 'V1', 'V2') GROUP BY 1)
SELECT l.*, CASE WHEN a.v IS NOT NULL THEN place_a ELSE place_b END AS gem, coalesce(a.v, b.v) AS visibility FROM links l LEFT JOIN lesser a ON a.name = place_a LEFT JOIN lesser b ON b.name = place_b WHERE a.v IS NOT NULL OR b.v IS NOT NULL
""")(lambda t: rollups.lesser_known_links(links(t), visible(t).withColumnRenamed("name", "canonical_name")))
query("ret_8_link_listing", """
WITH pt AS (SELECT k, arg_min(lat, o) AS lat, arg_min(lng, o) AS lng FROM (SELECT lower(place_name) AS k, 0 AS o, lat, lng FROM host_geography UNION ALL SELECT name, 1, lat, lng FROM visible WHERE lat IS NOT NULL) GROUP BY 1),
lesser AS (SELECT name, min(visibility) AS v FROM visible WHERE visibility IN ('V0', 'V1', 'V2') GROUP BY 1)
SELECT place_a, place_b, n_reviews, n_found_in, n_together, CASE WHEN a.v IS NOT NULL THEN place_a WHEN b.v IS NOT NULL THEN place_b END AS lesser_known_place, coalesce(a.v, b.v) AS lesser_known_visibility,
  pa.lat AS a_lat, pa.lng AS a_lng, pb.lat AS b_lat, pb.lng AS b_lng FROM links LEFT JOIN lesser a ON a.name = place_a LEFT JOIN lesser b ON b.name = place_b LEFT JOIN pt pa ON pa.k = place_a LEFT JOIN pt pb ON pb.k = place_b
""")(lambda t: retrieval.link_listing(links(t), visible(t).withColumnRenamed("name", "canonical_name"), t.host_geography))

# ---- coverage and audience --------------------------------------------------------------------------
COVERAGE_SQL = """district_cover AS MATERIALIZED (SELECT d.district, d.division, coalesce(p, 0) AS places, coalesce(n, 0) AS reviews, coalesce(rr, 0) AS recent_reviews, round_even(bn::DOUBLE / n, 3) AS bangla_share,
  coalesce(m, 0) AS mentions, coalesce(g, 0) AS gem_candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'no data' WHEN n < 100 OR p < 2 THEN 'thin' ELSE 'covered' END AS status
FROM (SELECT district, division FROM geo UNION ALL SELECT 'EMPTY', 'ASIA') d LEFT JOIN (SELECT district, count(DISTINCT place_name) AS p, count(*) AS n,
  count(*) FILTER (review_date >= (SELECT max(review_date) - INTERVAL 36 MONTH FROM host_reviews)) AS rr, count(*) FILTER (detected_language IN ('bn', 'bn-en-mixed')) AS bn FROM host_reviews GROUP BY 1) USING (district)
LEFT JOIN (SELECT h.district, count(*) AS m, count(DISTINCT CASE WHEN m.entity_id IN (SELECT entity_id FROM gem_candidates) THEN m.entity_id END) AS g FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id GROUP BY 1) USING (district))"""


def coverage(t: Tables):
    districts = t.geography.select("district", "division").unionByName(t.raw("region").limit(1).selectExpr("'EMPTY' AS district", "'ASIA' AS division"))
    return rollups.district_coverage(districts, t.host_reviews, t.linked_mentions, gems.candidates(t.entities, pairs(t)))


query("agg_18_district_coverage", f"WITH {COVERAGE_SQL} SELECT * FROM district_cover")(coverage)
query("agg_18_district_places", "SELECT district, place_name, count(*) AS reviews FROM host_reviews GROUP BY 1, 2")(
    lambda t: rollups.district_places(t.host_reviews))
query("agg_19_coverage_by_division", f"""WITH {COVERAGE_SQL} SELECT division, count(*) AS districts, count(*) FILTER (status = 'no data') AS no_data, count(*) FILTER (status = 'thin') AS thin,
  count(*) FILTER (status = 'covered') AS covered, CAST(sum(reviews) AS BIGINT) AS reviews, CAST(sum(places) AS BIGINT) AS places FROM district_cover GROUP BY 1""")(lambda t: rollups.coverage_by_division(coverage(t)))
query("agg_19_concentration", f"""WITH {COVERAGE_SQL} SELECT CAST(sum(reviews) AS BIGINT) AS reviews_in_top, array_to_string(list_sort(list(district)), '|') AS top_districts,
  round_even(sum(reviews)::DOUBLE / (SELECT sum(reviews) FROM district_cover), 3) AS top_share FROM (SELECT * FROM district_cover ORDER BY reviews DESC, district LIMIT 3)""")(lambda t: rollups.concentration(coverage(t)))
AUDIENCE_SQL = """audience_rows AS MATERIALIZED (SELECT review_id, place_name, source, division, CASE WHEN loc = 'bangladesh' THEN 'domestic' WHEN loc IS NOT NULL THEN 'foreign' WHEN detected_language IN ('bn', 'bn-en-mixed') THEN 'domestic' ELSE 'unknown' END AS audience,
  CASE WHEN loc = 'bangladesh' THEN 'stated location is Bangladesh' WHEN loc IS NOT NULL THEN concat('stated location is ', trim(user_location)) WHEN detected_language IN ('bn', 'bn-en-mixed') THEN concat('wrote in ', detected_language)
  ELSE 'no location, and wrote in English' END AS basis FROM (SELECT *, CASE WHEN trim(lower(user_location)) <> 'nan' THEN trim(lower(user_location)) END AS loc FROM host_reviews))"""
query("agg_20_audience", f"WITH {AUDIENCE_SQL} SELECT * FROM audience_rows")(lambda t: rollups.audience(t.host_reviews))
query("agg_21_audience_comparison", f"""WITH {AUDIENCE_SQL}, joined AS MATERIALIZED (SELECT coalesce(a.audience, 'unknown') AS audience, e.entity_type, e.canonical_name, e.found_in_division, coalesce(v.visibility, 'unknown') AS visibility
  FROM evidence e LEFT JOIN audience_rows a ON a.review_id = e.review_id LEFT JOIN visible v ON v.entity_id = e.entity_id),
dims AS (SELECT 'entity_type' AS dimension, entity_type AS "group", audience FROM joined UNION ALL SELECT 'canonical_name', canonical_name, audience FROM joined
  UNION ALL SELECT 'found_in_division', coalesce(found_in_division, '(none)'), audience FROM joined UNION ALL SELECT 'visibility', visibility, audience FROM joined),
g AS (SELECT dimension, "group", count(*) FILTER (audience = 'domestic') AS d, count(*) FILTER (audience = 'foreign') AS f, count(*) FILTER (audience = 'unknown') AS u FROM dims GROUP BY 1, 2)
SELECT dimension, "group", d AS domestic_mentions, f AS foreign_mentions, u AS unknown_mentions, round_even(d::DOUBLE / sum(d) OVER w, 4) AS domestic_share, round_even(f::DOUBLE / sum(f) OVER w, 4) AS foreign_share,
  d >= 5 AND f >= 5 AS comparable FROM g WINDOW w AS (PARTITION BY dimension)
""")(lambda t: rollups.audience_comparison(
    evidence(t).join(visible(t).select("entity_id", "visibility"), "entity_id", "left").withColumn("visibility", F.coalesce("visibility", F.lit("unknown"))),
    rollups.audience(t.host_reviews), ["entity_type", "found_in_division", "visibility", "canonical_name"]))


# ---- table builds -----------------------------------------------------------------------------------
def export_reviews(t: Tables):
    return t.host_reviews.selectExpr(
        "CAST(review_id AS bigint) AS row_order", "review_id", "place_name", "CASE WHEN CAST(review_id AS bigint) % 4 = 0 THEN ' ' ELSE district END AS city",
        "CASE WHEN detected_language = 'bn' THEN 'Beach resort' WHEN detected_language = 'en' THEN 'Museum' END AS category", "source",
        "review_rating * 1.5D AS place_avg_rating", "CASE WHEN CAST(review_id AS bigint) % 3 = 0 THEN concat('u/', review_id) END AS source_url")


def kind_geography(t: Tables):
    return t.host_geography.filter("district <> 'NATION_3'").selectExpr(
        "place_name", "CASE WHEN place_name LIKE '%BUILDING' THEN 'Built' END AS city", "district", "division", "CASE WHEN place_name LIKE '%MACHINERY' THEN 'works' END AS place_kind", "lat", "lng")


EXPORT_SQL = """export_reviews AS MATERIALIZED (SELECT CAST(review_id AS BIGINT) AS row_order, review_id, place_name, CASE WHEN CAST(review_id AS BIGINT) % 4 = 0 THEN ' ' ELSE district END AS city,
  CASE WHEN detected_language = 'bn' THEN 'Beach resort' WHEN detected_language = 'en' THEN 'Museum' END AS category, source, review_rating * 1.5::DOUBLE AS place_avg_rating,
  CASE WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN concat('u/', review_id) END AS source_url FROM host_reviews),
kind_geography AS (SELECT place_name, CASE WHEN place_name LIKE '%BUILDING' THEN 'Built' END AS city, district, division, CASE WHEN place_name LIKE '%MACHINERY' THEN 'works' END AS place_kind, lat, lng
  FROM host_geography WHERE district <> 'NATION_3')"""
query("join_4_places_build", f"""WITH {EXPORT_SQL},
a AS (SELECT place_name, min_by(CASE WHEN trim(city) <> '' THEN city END, CASE WHEN trim(city) <> '' THEN row_order END) AS csv_city, max(place_avg_rating) AS place_avg_rating,
  min_by(source_url, CASE WHEN source_url IS NOT NULL THEN row_order END) AS source_url FROM export_reviews GROUP BY 1),
c AS (SELECT place_name, category FROM (SELECT place_name, category, row_number() OVER (PARTITION BY place_name ORDER BY count(*) DESC, category) AS rn FROM export_reviews WHERE category IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
s AS (SELECT place_name, source FROM (SELECT place_name, source, row_number() OVER (PARTITION BY place_name ORDER BY count(*) DESC, source) AS rn FROM export_reviews GROUP BY 1, 2) WHERE rn = 1)
SELECT a.place_name, coalesce(g.city, csv_city) AS city, g.district, g.division, c.category, coalesce(g.place_kind, CASE WHEN regexp_matches(lower(coalesce(c.category, '')), 'hotel|resort|inn|guest') THEN 'accommodation' ELSE 'attraction' END) AS place_kind,
  s.source, a.place_avg_rating, a.source_url, CASE WHEN g.place_name IS NULL THEN 0 ELSE 1 END AS geo_resolved, g.lat, g.lng
FROM a LEFT JOIN c ON c.place_name = a.place_name LEFT JOIN s ON s.place_name = a.place_name LEFT JOIN kind_geography g ON g.place_name = a.place_name
""")(lambda t: joins.places_build(export_reviews(t), kind_geography(t)))
query("join_4_places_unmatched", f"""WITH {EXPORT_SQL}, r AS (SELECT DISTINCT place_name FROM export_reviews WHERE place_name NOT LIKE '%HOUSEHOLD'), g AS (SELECT DISTINCT place_name FROM kind_geography)
SELECT place_name, 'no geography' AS issue FROM r WHERE place_name NOT IN (SELECT place_name FROM g) UNION ALL SELECT place_name, 'no reviews' FROM g WHERE place_name NOT IN (SELECT place_name FROM r)
""")(lambda t: joins.places_unmatched(export_reviews(t).filter("place_name NOT LIKE '%HOUSEHOLD'"), kind_geography(t)))
query("join_5_reviews_build", """
SELECT CAST(d.doc_id AS VARCHAR) AS review_id, s_suppkey AS place_id, quality AS topic_id, d.source, CAST(n_chars % 5 + 1 AS BIGINT) AS review_rating, text AS review_text_clean,
  CASE WHEN doc_id % 4 < 3 THEN strftime(DATE '2020-01-01' + CAST(n_chars % 700 AS INTEGER), '%Y-%m-%d') END AS review_date, CASE WHEN doc_id % 4 < 3 THEN strftime(DATE '2020-01-01' + CAST(n_chars % 700 AS INTEGER), '%Y-%m') END AS review_month,
  CASE WHEN doc_id % 4 < 3 THEN CAST(year(DATE '2020-01-01' + CAST(n_chars % 700 AS INTEGER)) AS INTEGER) END AS review_year, CAST(length(text) AS INTEGER) AS text_length,
  CASE n_chars % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS reviewer_is_local_guide FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN supplier ON s_name = concat('Supplier#', lpad(CAST(n_chars % 20 AS VARCHAR), 9, '0'))
""")(lambda t: joins.reviews_build(
    _processed(t).unionByName(_processed(t).withColumn("row_order", F.col("row_order") + 10_000_000_000).withColumn("source", F.lit("later copy"))),
    t.raw("labels").selectExpr("CAST(doc_id AS string) AS review_id", "quality AS topic_id"), t.places))


def _processed(t: Tables):
    d = "date_add(DATE '2020-01-01', CAST(n_chars % 700 AS int))"
    return t.raw("documents").selectExpr(
        "doc_id AS row_order", "CAST(doc_id AS string) AS review_id", "concat('Supplier#', lpad(n_chars % 20, 9, '0')) AS place_name", "source", "n_chars % 5 + 1 AS review_rating",
        "text AS review_text_clean", f"CASE doc_id % 4 WHEN 0 THEN date_format({d}, 'yyyy-MM-dd') WHEN 1 THEN date_format({d}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") WHEN 2 THEN date_format({d}, 'dd/MM/yyyy') ELSE 'a week ago' END AS review_date",
        "CASE n_chars % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'no' ELSE '?' END AS reviewer_is_local_guide")
