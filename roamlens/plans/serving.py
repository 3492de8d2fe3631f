"""Rollups, taxonomy, listings, ranking and comparison over the review star."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.operators import joins, retrieval, rollups, topics
from roamlens.plans.frames_sql import even
from roamlens.plans.registry import query
from roamlens.sources.adapters import Tables


def stats(t: Tables):
    return rollups.place_stats(t.places, t.reviews)


def venue(t: Tables):
    return rollups.venue_preferences(t.reviews, t.places, t.topic_map, t.preferences)


def frequency(t: Tables):
    return rollups.preference_frequency(t.preferences, t.topic_map, t.topics)


def summary(t: Tables):
    return topics.topic_summary(t.topics, t.topic_mapping, t.long_tail, t.preferences)


# ---- rollups -------------------------------------------------------------------------
query("agg_1_place_stats", "SELECT * FROM place_stats")(stats)
query("agg_2_city_stats", "SELECT * FROM city_stats")(lambda t: rollups.city_stats(t.places, t.reviews))
query("agg_3_dataset_overview", """
SELECT (SELECT count(*) FROM reviews) AS total_reviews, (SELECT count(*) FROM places) AS total_places,
  (SELECT count(DISTINCT city) FROM places WHERE city <> '') AS total_cities,
  (SELECT count(*) FROM topics WHERE topic_id >= 0) AS total_topics, (SELECT count(*) FROM preferences) AS total_preferences,
  (SELECT count(*) FROM reviews WHERE topic_id >= 0) AS clustered_reviews,
  (SELECT count(*) FROM reviews WHERE topic_id < 0 OR topic_id IS NULL) AS outlier_reviews,
  (SELECT round(avg(review_rating), 3) FROM reviews) AS avg_rating,
  (SELECT min(review_date) FROM reviews) AS first_review_date, (SELECT max(review_date) FROM reviews) AS last_review_date
""")(lambda t: rollups.dataset_overview(t.reviews, t.places, t.topics, t.preferences))
query("agg_3_overview_long", """
SELECT 'total_reviews' AS metric, count(*)::DOUBLE AS value FROM reviews
UNION ALL SELECT 'unique_places', count(DISTINCT place_id)::DOUBLE FROM reviews
UNION ALL SELECT 'avg_rating', round_even(avg(review_rating), 3) FROM reviews
UNION ALL SELECT 'unique_cities', count(DISTINCT city)::DOUBLE FROM places
UNION ALL SELECT concat('reviews_source_', source), count(*)::DOUBLE FROM reviews GROUP BY 1
UNION ALL SELECT concat('reviews_language_', detected_language), count(*)::DOUBLE FROM reviews GROUP BY 1
""")(lambda t: rollups.overview_long(t.reviews, t.places))
query("agg_4_rating_distribution", """
SELECT source, review_rating, n AS review_count, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY source), 4) AS pct_in_source
FROM (SELECT source, review_rating, count(*) AS n FROM reviews GROUP BY 1, 2)
""")(lambda t: rollups.rating_distribution(t.reviews))
query("agg_5_monthly_volume", """
SELECT review_month, source, count(*) AS review_count FROM reviews GROUP BY 1, 2
""")(lambda t: rollups.temporal_volume(t.reviews))
query("agg_5_yearly_volume", """
SELECT review_year, source, count(*) AS review_count FROM reviews GROUP BY 1, 2
""")(lambda t: rollups.temporal_volume(t.reviews, "review_year"))
query("agg_6_preference_frequency", "SELECT * FROM frequency")(frequency)
query("agg_7_preference_coverage", """
SELECT preference_id, mapped_topic_count, covered_reviews, avg_similarity, coverage_status, coverage_action
FROM (SELECT preference_id, count(DISTINCT topic_id) AS mapped_topic_count, CAST(sum(review_count) AS BIGINT) AS covered_reviews,
        round_even(avg(similarity), 4) AS avg_similarity FROM summary GROUP BY 1)
LEFT JOIN (SELECT preference_id, coverage_status, coverage_action FROM coverage_checks) USING (preference_id)
""")(lambda t: rollups.preference_coverage(summary(t), t.coverage))
query("agg_8_city_preferences", "SELECT * FROM city_pref")(
    lambda t: rollups.city_preferences(t.reviews, t.places, t.topic_map, t.preferences))
query("agg_9_venue_preferences", "SELECT * FROM venue")(venue)
query("agg_10_mainstream_split", """
SELECT *, round_even(review_count::DOUBLE / sum(review_count) OVER (), 4) AS review_share FROM (
SELECT coalesce(preference_type, 'unmapped') AS preference_type, count(DISTINCT topic_id) AS topic_count,
  count(DISTINCT preference_id) AS preference_count, CAST(sum(review_count) AS BIGINT) AS review_count,
  round_even(avg(similarity), 4) AS avg_similarity, round_even(avg(sdd), 4) AS mean_sdd FROM summary GROUP BY 1)
""")(lambda t: rollups.mainstream_split(summary(t)))
query("agg_11_mapping_quality", """
SELECT 'direction1_total_topics' AS metric, count(*)::DOUBLE AS value FROM precision_checks
UNION ALL SELECT 'direction1_low_similarity_flags', count(*) FILTER (low_similarity_flag)::DOUBLE FROM precision_checks
UNION ALL SELECT 'direction1_ambiguous_flags', count(*) FILTER (ambiguous_flag)::DOUBLE FROM precision_checks
UNION ALL SELECT 'direction1_pass_rate', round_even(avg((precision_status = 'pass')::INT), 4) FROM precision_checks
UNION ALL SELECT 'direction2_total_preferences', count(*)::DOUBLE FROM coverage_checks
UNION ALL SELECT 'direction2_under_coverage', count(*) FILTER (coverage_status = 'under_coverage')::DOUBLE FROM coverage_checks
UNION ALL SELECT 'direction2_adequate', count(*) FILTER (coverage_status = 'adequate')::DOUBLE FROM coverage_checks
UNION ALL SELECT 'direction2_adequate_rate', round_even(avg((coverage_status = 'adequate')::INT), 4) FROM coverage_checks
""")(lambda t: rollups.mapping_quality(t.precision, t.coverage))
query("agg_22_taxonomy_counts", """
SELECT category, subcategory, count(preference_id) AS preferences, CAST(sum(review_count) AS BIGINT) AS review_count
FROM frequency GROUP BY ROLLUP (category, subcategory)
""")(lambda t: rollups.taxonomy_counts(frequency(t)))
query("agg_22_taxonomy_tree", """
SELECT category, CAST(sum(review_count) AS BIGINT) AS review_count,
  list(struct_pack(subcategory := subcategory, review_count := review_count, preferences := preferences) ORDER BY subcategory) AS subcategories
FROM (SELECT category, subcategory, CAST(sum(review_count) AS BIGINT) AS review_count,
  list(struct_pack(preference_id := preference_id, preference_label := preference_label, preference_type := preference_type,
       topic_count := topic_count, review_count := review_count) ORDER BY preference_id) AS preferences
  FROM frequency GROUP BY 1, 2) GROUP BY 1
""")(lambda t: rollups.taxonomy_tree(frequency(t)))

# ---- taxonomy tables --------------------------------------------------------------------
query("topic_4_dimension", "SELECT * FROM topics")(lambda t: t.topics)
query("topic_7_best_two", "SELECT * FROM topic_mapping")(lambda t: t.topic_mapping)
query("topic_9_precision_checks", "SELECT * FROM precision_checks")(lambda t: t.precision)
query("topic_10_secondary_mapping", "SELECT * FROM secondary")(lambda t: t.secondary)
query("topic_10_preference_map", "SELECT * FROM topic_map")(lambda t: t.topic_map)
query("topic_11_coverage_checks", "SELECT * FROM coverage_checks")(lambda t: t.coverage)
query("topic_12_recommendations", """
SELECT 'topic_precision_issue' AS type, concat('topic_', topic_id) AS target_id,
  CASE WHEN low_similarity_flag THEN 'high' ELSE 'medium' END AS severity,
  printf('mapped %s sim=%.4f, second=%s sim=%.4f, gap=%.4f', preference_id, similarity, second_best_preference_id, second_best_similarity, sim_gap) AS details,
  'manual_remap_review' AS suggested_action FROM precision_checks WHERE precision_status <> 'pass'
UNION ALL SELECT 'preference_coverage_issue', preference_id, 'medium', concat('mapped_topic_count=', mapped_topic_count), coverage_action
FROM coverage_checks WHERE coverage_status <> 'adequate'
UNION ALL SELECT 'no_critical_issues', 'all', 'info', 'No low-similarity or coverage violations under current thresholds.', 'expand_data'
WHERE (SELECT count(*) FROM precision_checks WHERE precision_status <> 'pass')
    + (SELECT count(*) FROM coverage_checks WHERE coverage_status <> 'adequate') = 0
""")(lambda t: topics.recommendations(t.precision, t.coverage))
query("topic_21_summary", "SELECT * FROM summary")(summary)
query("topic_22_keyword_fallback", """
SELECT topic_id, topic_name, review_count, CASE WHEN trim(top_keywords) = '' THEN
  array_to_string(list_filter(string_split(topic_name, '_')[2:], lambda x: x <> ''), ', ') ELSE trim(top_keywords) END AS top_keywords
FROM topics_summary
""")(lambda t: topics.fill_keywords(t.topics_summary))
query("topic_23_preference_dimension", "SELECT * FROM preferences")(lambda t: t.preferences)

# ---- spine and semi joins ------------------------------------------------------------------
SPINE = ("review_id, place_id, topic_id, source, review_rating, review_date, review_month, review_year, detected_language, text_length, "
         "place_name, city, district, division, category, place_kind, interpreted_label, preference_id, preference_label, "
         "preference_category, preference_subcategory, preference_type, mapping_similarity, mapping_confidence")
query("join_1_review_spine", f"SELECT {SPINE} FROM spine")(lambda t: t.spine)
query("join_2_review_spine_all", f"SELECT {SPINE} FROM spine_all")(lambda t: t.spine_all)
query("join_7_reviews_of_preference", """
SELECT review_id, place_id, topic_id FROM reviews r WHERE topic_id IN (SELECT topic_id FROM topic_map WHERE lower(preference_id) = 'p-small')
""")(lambda t: t.reviews.join(t.topic_map.filter("lower(preference_id) = 'p-small'"), "topic_id", "left_semi").select(
    "review_id", "place_id", "topic_id"))
query("join_7_reviews_without_topic", """
SELECT review_id, place_id FROM reviews r WHERE NOT EXISTS (SELECT 1 FROM topics_summary t WHERE t.topic_id = r.topic_id)
""")(lambda t: t.reviews.join(t.topics_summary, "topic_id", "left_anti").select("review_id", "place_id"))
query("join_7_entities_with_spelling", """
SELECT entity_id, canonical_name FROM entities e WHERE EXISTS (SELECT 1 FROM variants v WHERE v.entity_id = e.entity_id AND v.surface LIKE '%RED%')
""")(lambda t: t.entities.join(t.variants.filter("surface LIKE '%RED%'"), "entity_id", "left_semi").select("entity_id", "canonical_name"))
query("join_8_recent_reviews", """
SELECT review_id, review_date, review_date >= (SELECT max(review_date) - INTERVAL 36 MONTH FROM reviews) AS is_recent FROM reviews
""")(lambda t: t.reviews.select("review_id", "review_date", (F.col("review_date") >= joins.recent_bound(t.reviews)).alias("is_recent")))

# ---- listings and details ---------------------------------------------------------------------
query("ret_1_places_page", """
SELECT *, (SELECT count(*) FROM place_stats WHERE lower(division) = 'asia' AND coalesce(avg_review_rating, 0) >= 2.9) AS total
FROM place_stats WHERE lower(division) = 'asia' AND coalesce(avg_review_rating, 0) >= 2.9
ORDER BY review_count DESC, place_name LIMIT 10 OFFSET 2
""")(lambda t: retrieval.page(
    stats(t), retrieval.equals_ci("division", "Asia") & (F.coalesce("avg_review_rating", F.lit(0)) >= 2.9),
    [F.desc("review_count"), F.asc("place_name")], 10, 2))
query("ret_1_reviews_page", """
SELECT review_id, place_name, review_rating, review_date, text_length, preference_id, (SELECT count(*) FROM spine WHERE lower(source) = 'r'
  AND review_rating BETWEEN 2 AND 4 AND review_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND place_name LIKE '%00000%') AS total
FROM spine WHERE lower(source) = 'r' AND review_rating BETWEEN 2 AND 4 AND review_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
  AND place_name LIKE '%00000%' ORDER BY review_date DESC, review_id LIMIT 25
""")(lambda t: retrieval.page(
    t.spine, retrieval.equals_ci("source", "r") & F.col("review_rating").between(2, 4)
    & F.col("review_date").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")) & F.contains("place_name", F.lit("00000")),
    [F.desc("review_date"), F.asc("review_id")], 25).select(
    "review_id", "place_name", "review_rating", "review_date", "text_length", "preference_id", "total"))
query("ret_3_place_detail", """
SELECT place_id, 'place' AS section, place_name AS item, review_count AS n, avg_review_rating AS value FROM place_stats
UNION ALL SELECT place_id, 'preference', preference_id, review_count, avg_rating FROM venue
UNION ALL SELECT place_id, 'rating', CAST(review_rating AS VARCHAR), count(*), NULL FROM reviews GROUP BY 1, 3
""")(lambda t: retrieval.place_detail(stats(t), venue(t), t.reviews))
query("ret_3_topic_places", """
SELECT topic_id, place_id, review_count, avg_rating, rank, place_name, city FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY review_count DESC, place_id) AS INTEGER) AS rank FROM (
SELECT topic_id, place_id, count(*) AS review_count, round(avg(review_rating), 3) AS avg_rating FROM reviews WHERE topic_id IS NOT NULL GROUP BY 1, 2))
JOIN (SELECT place_id, place_name, city FROM places) USING (place_id) WHERE rank <= 10
""")(lambda t: retrieval.topic_places(t.reviews, t.places))
query("ret_3_topic_longest_reviews", """
SELECT topic_id, review_id, place_id, review_rating, text_length, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id
ORDER BY text_length DESC, review_id) AS INTEGER) AS rank FROM spine WHERE topic_id IS NOT NULL) WHERE rank <= 5
""")(lambda t: retrieval.longest_reviews(t.spine, "topic_id"))
query("ret_3_preference_topics", """
SELECT m.preference_id, m.topic_id, mapping_rank, similarity, interpreted_label, top_keywords, review_count
FROM topic_map m JOIN topics t ON t.topic_id = m.topic_id
""")(lambda t: retrieval.preference_topics(t.topic_map, t.topics))
query("ret_3_preference_cities", """
SELECT preference_id, rank, city, review_count, avg_rating FROM (SELECT *, CAST(row_number() OVER (PARTITION BY preference_id
ORDER BY review_count DESC, city) AS INTEGER) AS rank FROM city_pref) WHERE rank <= 5
""")(lambda t: retrieval.preference_leaders(
    rollups.city_preferences(t.reviews, t.places, t.topic_map, t.preferences), "city"))
query("ret_7_sample_reviews", """
SELECT side, place_id, review_id, review_rating, text_length, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY place_id, side ORDER BY key, text_length DESC, review_id) AS INTEGER) AS rank FROM (
  SELECT 'positive' AS side, place_id, review_id, review_rating, text_length, -review_rating AS key FROM spine WHERE text_length > 40 AND review_rating >= 4
  UNION ALL SELECT 'critical', place_id, review_id, review_rating, text_length, review_rating FROM spine WHERE text_length > 40 AND review_rating <= 3))
WHERE rank <= 2
""")(lambda t: retrieval.sample_reviews(t.spine))
query("ret_14_newest_review_per_place", """
SELECT place_id, review_id, review_date, rank FROM (SELECT place_id, review_id, review_date, CAST(row_number() OVER (
PARTITION BY place_id ORDER BY review_date DESC, review_id) AS INTEGER) AS rank FROM reviews) WHERE rank = 1
""")(lambda t: retrieval.top_per_key(t.reviews.select("place_id", "review_id", "review_date"), ["place_id"],
                                     [F.desc("review_date"), F.asc("review_id")], 1))
query("ret_15_set_difference", """
SELECT place_id FROM places EXCEPT SELECT place_id FROM reviews WHERE source = 'R' AND review_rating = 5 AND review_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'
""")(lambda t: t.places.select("place_id").exceptAll(
    t.places.join(t.reviews.filter("source = 'R' AND review_rating = 5 AND review_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'"), "place_id", "left_semi").select("place_id")))
query("ret_16_long_tail_topics", """
SELECT l.topic_id, l.interpreted_label, l.preference_id, l.sdd, l.corpus_share, l.review_count FROM long_tail l WHERE is_long_tail OR scarce
""")(lambda t: t.long_tail.filter("is_long_tail OR scarce").select(
    "topic_id", "interpreted_label", "preference_id", "sdd", "corpus_share", "review_count"))
query("ret_16_form_options", """
SELECT DISTINCT division, district, city FROM places WHERE city IS NOT NULL AND place_kind = 'attraction'
""")(lambda t: t.places.filter("city IS NOT NULL AND place_kind = 'attraction'").select("division", "district", "city").distinct())

# ---- search -----------------------------------------------------------------------------------------
query("ret_4_search", """
SELECT * FROM (SELECT 'place' AS kind, CAST(place_id AS VARCHAR) AS id, place_name AS label, review_count::DOUBLE AS score FROM place_stats
  WHERE place_name ILIKE '%11%' OR city ILIKE '%11%' ORDER BY review_count DESC, place_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'city', city, city, review_count::DOUBLE FROM city_stats WHERE city ILIKE '%11%' OR district ILIKE '%11%'
  ORDER BY review_count DESC, city LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'preference', preference_id, preference_label, review_count::DOUBLE FROM frequency JOIN
  (SELECT preference_id, preference_description FROM preferences) USING (preference_id)
  WHERE preference_label ILIKE '%11%' OR preference_description ILIKE '%11%' OR subcategory ILIKE '%11%' ORDER BY review_count DESC, preference_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'topic', CAST(topic_id AS VARCHAR), coalesce(interpreted_label, concat('Topic ', topic_id)), review_count::DOUBLE FROM topics
  WHERE interpreted_label ILIKE '%11%' OR top_keywords ILIKE '%11%' OR interpretation ILIKE '%11%' ORDER BY review_count DESC, topic_id LIMIT 5)
""")(lambda t: retrieval.search("11", {
    "places": stats(t), "cities": rollups.city_stats(t.places, t.reviews),
    "preferences": frequency(t).join(t.preferences.select("preference_id", "preference_description"), "preference_id"),
    "topics": t.topics}))
query("ret_2_spelling_insensitive_filter", """
SELECT doc_id AS review_id FROM documents WHERE text ILIKE '%thon the%'
""")(lambda t: t.texts.filter(retrieval.T.contains_any_form(F.col("review_text"), F.lit("Thon THE"))).select("review_id"))
query("ret_4_search_reviews", """
SELECT 'review' AS kind, CAST(doc_id AS VARCHAR) AS id, (n_chars % 5 + 1)::DOUBLE AS score FROM documents
WHERE text ILIKE '%then%' AND text ILIKE '%onst%' ORDER BY text ILIKE '%then onst%' DESC, n_chars % 5 DESC, length(text), doc_id LIMIT 20
""")(lambda t: retrieval.search("then onst", {"reviews": t.raw("documents").selectExpr(
    "doc_id AS review_id", "text AS review_text", "n_chars % 5 + 1 AS review_rating")}, per_kind=20).select("kind", "id", "score"))


# ---- ranking and comparison ----------------------------------------------------------------------------
def requests(t: Tables):
    """Trip wishes of every customer: up to two preferences and, for some, a division or city."""
    prefs = "array('SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO', 'ECONOMY')"
    c = t.raw("customer").join(t.geography, F.expr("c_nationkey = n_nationkey"))
    return c.selectExpr(
        "c_custkey AS request_id",
        f"CASE WHEN c_mktsegment = 'BUILDING' THEN array() ELSE array(concat('P-', {prefs}[c_custkey % 6]), concat('p-', lower({prefs}[c_nationkey % 6]))) END AS wanted",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN concat(district, '/1') END AS city",
        "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN division END AS division",
        "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'attraction' END AS place_kind",
        "array(concat(district, '/2')) AS exclude_cities", "1 AS min_reviews", "10 AS limit")


REQUESTS_SQL = """requests AS MATERIALIZED (SELECT c_custkey AS request_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN []::VARCHAR[] ELSE list_sort(list_distinct([concat('P-', p[c_custkey % 6 + 1]), concat('P-', p[c_nationkey % 6 + 1])])) END AS wanted,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN concat(district, '/1') END AS q_city,
  CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN division END AS q_division,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'attraction' END AS q_kind, concat(district, '/2') AS skip
  FROM customer JOIN geo ON c_nationkey = n_nationkey, (SELECT ['SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO', 'ECONOMY'] AS p))"""


RECOMMEND_SQL = f"""WITH {REQUESTS_SQL},
cand AS (SELECT r.request_id, r.wanted, s.place_id, s.place_name, s.city, s.district, s.division, s.category, s.place_kind, s.review_count,
    s.avg_review_rating AS avg_rating, coalesce(s.avg_review_rating, 0) / 5 AS rn
  FROM requests r JOIN place_stats s ON (q_city IS NULL OR lower(q_city) = lower(s.city)) AND (q_division IS NULL OR lower(q_division) = lower(s.division))
    AND (q_kind IS NULL OR q_kind = s.place_kind) AND (s.city IS NULL OR lower(s.city) <> lower(skip)) AND s.review_count >= 1),
ev AS (SELECT c.request_id, c.place_id, list_sort(list(v.preference_id)) AS matched_preferences, CAST(sum(v.review_count) AS BIGINT) AS m
  FROM cand c JOIN venue v ON v.place_id = c.place_id AND list_contains(c.wanted, upper(v.preference_id)) GROUP BY 1, 2),
scored_places AS (SELECT c.*, matched_preferences, m AS matched_review_count, {even('(m::DOUBLE / review_count)', 4)} AS evidence_share,
    {even('(0.45::DOUBLE * (m::DOUBLE / review_count) + 0.30::DOUBLE * len(matched_preferences) / len(wanted) + 0.25::DOUBLE * rn)', 4)} AS match_score
  FROM cand c JOIN ev USING (request_id, place_id) WHERE len(wanted) > 0
  UNION ALL SELECT c.*, []::VARCHAR[], 0, NULL, {even('(0.75::DOUBLE * rn + 0.25::DOUBLE * least(review_count / 50.0::DOUBLE, 1.0::DOUBLE))', 4)} FROM cand c WHERE len(wanted) = 0)
SELECT request_id, place_id, place_name, city, district, division, category, place_kind, review_count, avg_rating, matched_preferences,
  matched_review_count, evidence_share, match_score, rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY match_score DESC, review_count DESC, place_id) AS INTEGER) AS rank FROM scored_places)
WHERE rank <= 10"""
query("ret_5_recommend", RECOMMEND_SQL)(lambda t: retrieval.recommend(requests(t), stats(t), venue(t)))


def comparisons(t: Tables):
    """Every supplier compared with the two or three listed after it."""
    s = t.raw("supplier").select("s_suppkey")
    top = s.agg(F.max("s_suppkey")).scalar()
    return s.select(F.col("s_suppkey").alias("compare_id"), F.explode(F.expr("sequence(0, 2 + s_suppkey % 2)")).alias("d")).select(
        "compare_id", ((F.col("compare_id") + F.col("d")) % (top + 1)).alias("place_id"))


COMPARE_SQL = """WITH comparisons AS (SELECT s_suppkey AS compare_id, (s_suppkey + d) % ((SELECT max(s_suppkey) FROM supplier) + 1) AS place_id
  FROM (SELECT s_suppkey, unnest(range(0, 3 + s_suppkey % 2)) AS d FROM supplier))"""
query("ret_6_compare_metrics", COMPARE_SQL + """,
wide AS (SELECT compare_id, s.place_id, avg_review_rating AS avg_rating, review_count::DOUBLE AS review_count,
  round_even(positive_reviews::DOUBLE / nullif(review_count, 0), 4) AS positive_share, round_even(negative_reviews::DOUBLE / nullif(review_count, 0), 4) AS negative_share,
  coalesce(breadth, 0)::DOUBLE AS preference_breadth, round_even(coalesce(mapped, 0)::DOUBLE / nullif(review_count, 0), 4) AS evidence_share
  FROM comparisons c JOIN place_stats s ON s.place_id = c.place_id LEFT JOIN (SELECT place_id, count(*) AS breadth, sum(review_count) AS mapped FROM venue GROUP BY 1) v ON v.place_id = c.place_id),
metric_rows AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN (avg_rating, review_count, positive_share, negative_share, preference_breadth, evidence_share))),
best AS (SELECT *, value = CASE WHEN metric = 'negative_share' THEN min(value) OVER w ELSE max(value) OVER w END AS b FROM metric_rows WINDOW w AS (PARTITION BY compare_id, metric))
SELECT compare_id, metric, place_id, value, coalesce(b, false) AND sum(coalesce(b, false)::INT) OVER (PARTITION BY compare_id, metric) = 1 AS is_leader FROM best
""")(lambda t: retrieval.compare_metrics(comparisons(t), stats(t), venue(t)))
query("ret_6_compare_preferences", COMPARE_SQL + """
SELECT compare_id, preference_id, count(DISTINCT place_id) AS held_by, CAST(sum(review_count) AS BIGINT) AS review_count,
  any_value(n) AS n_places, CASE WHEN count(DISTINCT place_id) = any_value(n) THEN 'shared' ELSE 'distinct' END AS scope
FROM comparisons JOIN venue USING (place_id) JOIN (SELECT compare_id, count(DISTINCT place_id) AS n FROM comparisons GROUP BY 1) USING (compare_id) GROUP BY 1, 2
""")(lambda t: retrieval.compare_preferences(comparisons(t), venue(t)))
query("ret_6_top_preference", COMPARE_SQL + """
SELECT compare_id, place_id, preference_label AS top_preference FROM (SELECT compare_id, place_id, preference_label, row_number() OVER (
PARTITION BY compare_id, place_id ORDER BY review_count DESC, preference_id) AS rn FROM comparisons JOIN venue USING (place_id)) WHERE rn = 1
""")(lambda t: retrieval.top_preference(comparisons(t), venue(t)))
