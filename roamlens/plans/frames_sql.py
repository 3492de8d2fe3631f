"""The canonical frames as SQL, so a check query can name them."""

from __future__ import annotations

import re

FRAMES: dict[str, str] = {}

FRAMES["geo"] = """
SELECT n_nationkey, n_name AS district, r_name AS division FROM nation JOIN region ON n_regionkey = r_regionkey"""

FRAMES["places"] = """
SELECT s_suppkey AS place_id, s_name AS place_name,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat(district, '/', s_suppkey % 3) END AS city, district, division,
  CASE WHEN s_acctbal < 2500 THEN 'hotel' ELSE 'sight' END AS category,
  CASE WHEN s_acctbal < 2500 THEN 'accommodation' ELSE 'attraction' END AS place_kind,
  'list' AS source, round(s_acctbal / 2000, 1) AS place_avg_rating, concat('http://maps/', s_suppkey) AS source_url,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE 20.5::DOUBLE + (s_suppkey * 37 % 620)::DOUBLE / 100 END AS lat,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE 88.0::DOUBLE + (s_suppkey * 91 % 470)::DOUBLE / 100 END AS lng
FROM supplier JOIN geo ON s_nationkey = n_nationkey"""

FRAMES["reviews"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id, l_suppkey AS place_id,
  CASE WHEN l_discount = 0.1 THEN NULL WHEN l_discount = 0.09 THEN -1 ELSE CAST(substr(p_brand, 7) AS INTEGER) END AS topic_id,
  l_returnflag AS source, CAST(ceil(l_quantity / 10) AS INTEGER) AS review_rating, CAST(l_shipdate AS DATE) AS review_date,
  strftime(l_shipdate, '%Y-%m') AS review_month, CAST(year(l_shipdate) AS INTEGER) AS review_year,
  CASE WHEN l_linestatus = 'F' THEN 'bn' ELSE 'en' END AS detected_language,
  CAST(round(l_extendedprice / 100) AS INTEGER) AS text_length
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""

FRAMES["topics_summary"] = """
SELECT topic_id, concat(topic_id, '_', replace(lo, ' ', '_')) AS topic_name,
  CASE WHEN topic_id % 5 = 0 THEN '' ELSE concat(lo, ', ', hi) END AS top_keywords, n AS review_count
FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS topic_id, count(*) AS n, min(p_name) AS lo, max(p_name) AS hi
      FROM part GROUP BY 1)"""

FRAMES["interpretations"] = """
SELECT topic_id, concat('Theme ', topic_id) AS interpreted_label,
  concat('reviews about ', replace(topic_name, '_', ' ')) AS interpretation,
  CASE WHEN topic_id < 10 THEN 'nature' ELSE 'culture' END AS dimension_hint
FROM topics_summary WHERE topic_id <> 7"""

FRAMES["preference_classes"] = """
SELECT DISTINCT concat('P-', p_type) AS preference_id,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'Size' ELSE 'Range' END AS category,
  CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Ends' WHEN p_type IN ('MEDIUM', 'STANDARD') THEN 'Middle' ELSE 'Offers' END AS subcategory,
  lower(p_type) AS preference_label, concat('visitors who like ', lower(p_type), ' things') AS preference_description,
  CAST(NULL AS VARCHAR) AS preference_type
FROM part"""

FRAMES["topic_scores"] = """
SELECT topic_id, preference_id, least(1.0::DOUBLE, n * 2.2::DOUBLE / sum(n) OVER (PARTITION BY topic_id)) AS similarity
FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS topic_id, concat('P-', p_type) AS preference_id, count(*) AS n
      FROM part GROUP BY 1, 2)"""

FRAMES["scored"] = """
SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, preference_id) AS rn FROM topic_scores"""

FRAMES["topic_mapping"] = """
SELECT a.topic_id, i.interpreted_label, a.preference_id, p.category, p.subcategory, p.preference_label AS preference,
  round_even(a.similarity, 4) AS similarity, coalesce(b.preference_id, a.preference_id) AS second_best_preference_id,
  round_even(coalesce(b.similarity, a.similarity), 4) AS second_best_similarity,
  CASE WHEN a.similarity >= 0.4 THEN 'high' ELSE 'low' END AS confidence, a.similarity < 0.4 AS needs_review,
  0.4::DOUBLE AS tau_sim
FROM (SELECT * FROM scored WHERE rn = 1) a LEFT JOIN (SELECT * FROM scored WHERE rn = 2) b USING (topic_id)
JOIN preference_classes p ON p.preference_id = a.preference_id LEFT JOIN interpretations i ON i.topic_id = a.topic_id"""

FRAMES["precision_checks"] = """
SELECT *, CASE WHEN low_similarity_flag THEN 'low_similarity' WHEN ambiguous_flag THEN 'ambiguous' ELSE 'pass' END AS precision_status
FROM (SELECT *, sim_gap < 0.08 AS ambiguous_flag, similarity < 0.4 AS low_similarity_flag FROM
  (SELECT *, round_even(similarity - second_best_similarity, 4) AS sim_gap FROM topic_mapping))"""

FRAMES["secondary"] = """
SELECT topic_id, second_best_preference_id AS preference_id, second_best_similarity AS similarity,
  preference_id AS primary_preference_id, similarity AS primary_similarity, sim_gap, 2 AS mapping_rank
FROM precision_checks WHERE ambiguous_flag AND NOT low_similarity_flag AND second_best_similarity >= 0.4"""

FRAMES["topic_map"] = """
SELECT topic_id, 1 AS mapping_rank, preference_id, similarity, second_best_preference_id, second_best_similarity,
  round_even(similarity - second_best_similarity, 4) AS sim_gap, confidence, CAST(needs_review AS INTEGER) AS needs_review, tau_sim
FROM topic_mapping
UNION ALL
SELECT topic_id, 2, preference_id, similarity, primary_preference_id, primary_similarity, sim_gap, 'medium', 1, 0.4::DOUBLE FROM secondary"""

FRAMES["coverage_checks"] = """
SELECT c.preference_id, c.preference_label, coalesce(m.n, 0) AS mapped_topic_count, coalesce(q.n, 0) AS primary_topic_count,
  CASE WHEN coalesce(m.n, 0) < 3 THEN 'under_coverage' WHEN m.n > 20 THEN 'over_coverage' ELSE 'adequate' END AS coverage_status,
  CASE WHEN coalesce(m.n, 0) < 3 THEN 'merge_or_expand' WHEN m.n > 20 THEN 'split' ELSE 'no_action' END AS coverage_action
FROM preference_classes c
LEFT JOIN (SELECT preference_id, count(DISTINCT topic_id) AS n FROM topic_map GROUP BY 1) m USING (preference_id)
LEFT JOIN (SELECT preference_id, count(*) AS n FROM topic_mapping GROUP BY 1) q USING (preference_id)"""

FRAMES["long_tail"] = """
SELECT topic_id, interpreted_label, preference_id, review_count, corpus_share, corpus_share < 0.04 AS scarce,
  round(similarity, 4) AS max_sim_to_abundant, round(1 - similarity, 4) AS sdd,
  CASE WHEN corpus_share < 0.03 AND 1 - similarity > 0.5 THEN 'long_tail' ELSE 'mainstream' END AS preference_type,
  corpus_share < 0.03 AND 1 - similarity > 0.5 AS is_long_tail
FROM (SELECT m.topic_id, m.interpreted_label, m.preference_id, m.similarity, c.n AS review_count,
        round_even(c.n / (SELECT count(*) FROM reviews)::DOUBLE, 4) AS corpus_share
      FROM topic_mapping m JOIN (SELECT topic_id, count(*) AS n FROM reviews GROUP BY 1) c USING (topic_id))"""

FRAMES["topics"] = """
SELECT topic_id, coalesce(topic_name, CASE WHEN topic_id = -1 THEN '-1_outliers' END) AS topic_name, top_keywords,
  coalesce(review_count, actual) AS review_count,
  round_even(coalesce(review_count, actual)::DOUBLE / (SELECT greatest(count(*), 1) FROM reviews), 4) AS corpus_share,
  coalesce(interpreted_label, CASE WHEN topic_id = -1 THEN 'Unclustered (outliers)' END) AS interpreted_label,
  interpretation, dimension_hint
FROM topics_summary FULL JOIN (SELECT topic_id, count(*) AS actual FROM reviews WHERE topic_id IS NOT NULL GROUP BY 1) USING (topic_id)
LEFT JOIN interpretations USING (topic_id)"""

FRAMES["preferences"] = """
SELECT preference_id, category, subcategory, preference_label, preference_description,
  CASE WHEN tail THEN 'long_tail' ELSE coalesce(preference_type, 'mainstream') END AS preference_type
FROM preference_classes LEFT JOIN (SELECT preference_id, bool_or(is_long_tail) AS tail FROM long_tail GROUP BY 1) USING (preference_id)"""

FRAMES["spine_all"] = """
SELECT r.*, m.mapping_rank, p.place_name, p.city, p.district, p.division, p.category, p.place_kind, t.interpreted_label, m.preference_id,
  q.preference_label, q.category AS preference_category, q.subcategory AS preference_subcategory, q.preference_type,
  m.similarity AS mapping_similarity, m.confidence AS mapping_confidence
FROM reviews r LEFT JOIN places p ON p.place_id = r.place_id LEFT JOIN topics t ON t.topic_id = r.topic_id
LEFT JOIN topic_map m ON m.topic_id = r.topic_id LEFT JOIN preferences q ON q.preference_id = m.preference_id"""

FRAMES["spine"] = "SELECT * FROM spine_all WHERE coalesce(mapping_rank, 1) = 1"

FRAMES["place_stats"] = """
SELECT p.*, count(r.place_id) AS review_count, round(avg(r.review_rating), 3) AS avg_review_rating,
  count(*) FILTER (r.review_rating >= 4) AS positive_reviews, count(*) FILTER (r.review_rating <= 2) AS negative_reviews,
  min(r.review_date) AS first_review_date, max(r.review_date) AS last_review_date
FROM places p LEFT JOIN reviews r ON r.place_id = p.place_id GROUP BY ALL"""

FRAMES["city_stats"] = """
SELECT city, district, division, count(DISTINCT p.place_id) AS place_count, count(r.place_id) AS review_count,
  round(avg(review_rating), 3) AS avg_review_rating
FROM places p LEFT JOIN reviews r ON r.place_id = p.place_id WHERE city IS NOT NULL AND city <> '' GROUP BY 1, 2, 3"""

FRAMES["venue"] = """
SELECT place_id, place_name, city, category, place_kind, preference_id, preference_label, preference_type,
  count(*) AS review_count, round(avg(review_rating), 3) AS avg_rating
FROM spine_all WHERE preference_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""

FRAMES["city_pref"] = """
SELECT city, preference_id, preference_label, preference_type, min(district) AS district, min(division) AS division,
  count(*) AS review_count, round(avg(review_rating), 3) AS avg_rating
FROM spine_all WHERE preference_id IS NOT NULL AND city IS NOT NULL AND city <> '' GROUP BY 1, 2, 3, 4"""

FRAMES["summary"] = """
SELECT t.topic_id, topic_name, top_keywords, t.review_count, interpretation, dimension_hint, m.interpreted_label, m.preference_id,
  m.category, m.subcategory, m.preference AS preference_label, m.similarity, m.confidence, m.needs_review,
  l.preference_type, l.sdd, l.corpus_share, q.preference_description,
  array_to_string(list_filter(list_transform(string_split(top_keywords, ','), lambda x: trim(x)), lambda x: x <> '')[1:3], '; ') AS summary_signals
FROM topics t JOIN topic_mapping m ON m.topic_id = t.topic_id JOIN long_tail l ON l.topic_id = t.topic_id
LEFT JOIN preferences q ON q.preference_id = m.preference_id"""

FRAMES["frequency"] = """
SELECT preference_id, preference_label, category, subcategory, preference_type, topic_count, review_count, avg_similarity, min_confidence,
  round_even(review_count::DOUBLE / nullif(sum(review_count) OVER (), 0), 4) AS review_share
FROM (SELECT q.preference_id, q.preference_label, q.category, q.subcategory, q.preference_type, count(DISTINCT m.topic_id) AS topic_count,
        CAST(coalesce(sum(t.review_count), 0) AS BIGINT) AS review_count, (2 * sum(CAST(round(m.similarity * 1e8) AS BIGINT)) + 10000 * count(m.similarity)) // (20000 * count(m.similarity)) / 1e4::DOUBLE AS avg_similarity,
        min(m.confidence) AS min_confidence
      FROM preferences q LEFT JOIN topic_map m ON m.preference_id = q.preference_id LEFT JOIN topics t ON t.topic_id = m.topic_id
      GROUP BY 1, 2, 3, 4, 5)"""

FRAMES["host_reviews"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, concat(district, ' ', c_mktsegment) AS place_name, district, division,
  least(5, CAST(ceil(o_totalprice / 100000) AS INTEGER)) AS review_rating, CAST(o_orderdate AS DATE) AS review_date,
  o_orderpriority AS source,
  CASE o_orderstatus WHEN 'F' THEN 'bn' WHEN 'O' THEN 'en' ELSE 'bn-en-mixed' END AS detected_language,
  CASE WHEN c_nationkey < 4 THEN ' Bangladesh' WHEN c_nationkey < 12 THEN district WHEN c_nationkey < 14 THEN 'nan' END AS user_location
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN geo ON c_nationkey = n_nationkey"""

FRAMES["host_geography"] = """
SELECT DISTINCT concat(district, ' ', c_mktsegment) AS place_name, district, division,
  21.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS lat, 89.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS lng
FROM customer JOIN geo ON c_nationkey = n_nationkey"""

FRAMES["mentions"] = """
SELECT mention_id, review_id, entity_type, surface, concat(entity_type, '/', lower(surface)) AS entity_id,
  trim(repeat(concat(surface, '. '), quantity % 9 + 1)) AS sentence,
  CASE WHEN l_linestatus = 'F' THEN 'bn' ELSE 'en' END AS language,
  CASE WHEN quantity % 3 = 0 THEN 'case' ELSE 'exact' END AS match_kind, 'gazetteer' AS extractor
FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS mention_id, CAST(l_orderkey AS VARCHAR) AS review_id,
  CASE p_type WHEN 'STANDARD' THEN 'FOOD' WHEN 'SMALL' THEN 'ACTIVITY' WHEN 'ECONOMY' THEN 'ACCESS' WHEN 'PROMO' THEN 'TIP' ELSE 'PLACE' END AS entity_type,
  CASE WHEN l_returnflag = 'R' THEN upper(concat(p_name, ' ', p_brand)) ELSE concat(p_name, ' ', p_brand) END AS surface,
  CAST(l_quantity AS INTEGER) AS quantity, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)"""

FRAMES["variants"] = """
SELECT concat(entity_type, '/', lower(surface)) AS entity_id, surface, entity_type, count(*) AS mentions FROM mentions GROUP BY 1, 2, 3"""

FRAMES["entities"] = """
SELECT entity_id, entity_type, lower(min(surface)) AS canonical_name, count(DISTINCT surface) AS n_variants, count(*) AS n_mentions,
  count(DISTINCT review_id) AS n_reviews FROM mentions GROUP BY 1, 2"""

FRAMES["evidence"] = """
SELECT m.*, e.canonical_name, h.place_name AS found_in_place, h.district AS found_in_district, h.division AS found_in_division,
  h.review_rating, h.review_date
FROM mentions m LEFT JOIN entities e ON e.entity_id = m.entity_id LEFT JOIN host_reviews h ON h.review_id = m.review_id"""

FRAMES["lookups"] = """
SELECT entity_id, name, CASE WHEN k % 11 = 0 THEN 'error' ELSE 'ok' END AS osm_status,
  CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS wikidata_status, k % 3 <> 0 AS osm_found, k % 2 = 0 AS wikidata_found,
  CASE WHEN k % 3 <> 0 THEN round(top / 200.0::DOUBLE, 3) END AS osm_importance,
  CASE WHEN k % 2 = 0 THEN CAST(all_size % 25 AS INTEGER) END AS wikidata_sitelinks,
  CASE WHEN k % 5 = 0 THEN name END AS maps_place,
  CASE WHEN k % 5 = 0 AND k % 10 = 0 THEN k * 13 % 2000 END AS maps_review_count,
  CASE WHEN k % 4 = 0 THEN 22.0::DOUBLE + (k % 40)::DOUBLE / 10 END AS lat,
  CASE WHEN k % 4 = 0 THEN 89.0::DOUBLE + (k % 30)::DOUBLE / 10 END AS lng
FROM (SELECT concat('PLACE/', lower(concat(p_name, ' ', p_brand))) AS entity_id, lower(concat(p_name, ' ', p_brand)) AS name,
  max(p_size) AS top, min(p_partkey) AS k, CAST(sum(p_size) AS BIGINT) AS all_size
  FROM part WHERE p_type IN ('MEDIUM', 'LARGE') GROUP BY 1, 2)"""

FRAMES["texts"] = """
SELECT doc_id AS review_id, source, source AS place_name, text AS review_text, lang AS review_language FROM documents"""


FRAMES["entity_reviews"] = "SELECT entity_id, review_id, count(*) AS m FROM mentions GROUP BY 1, 2"

FRAMES["visible_lookup"] = """
SELECT *, CASE WHEN visibility = 'V3' THEN concat('well documented: ', links, ' sitelink(s)') WHEN visibility = 'V2' THEN concat('moderately documented: ', links, ' sitelink(s)')
  WHEN visibility = 'V1' THEN CASE WHEN osm_found THEN 'on the map but barely documented' ELSE 'in the knowledge base but barely documented' END
  WHEN visibility = 'V0' THEN 'absent from both sources' WHEN osm_status <> 'ok' AND wikidata_status <> 'ok' THEN 'neither source could be reached'
  ELSE 'absent from one source, the other was unreachable' END AS visibility_reason
FROM (SELECT *, coalesce(wikidata_sitelinks, -1) AS links,
  CASE WHEN osm_status <> 'ok' AND wikidata_status <> 'ok' THEN 'unknown' WHEN coalesce(wikidata_sitelinks, -1) >= 20 OR coalesce(osm_importance, 0) >= 0.35 THEN 'V3'
  WHEN coalesce(wikidata_sitelinks, -1) >= 5 OR coalesce(osm_importance, 0) >= 0.10 THEN 'V2' WHEN osm_found OR wikidata_found THEN 'V1'
  WHEN osm_status = 'ok' AND wikidata_status = 'ok' THEN 'V0' ELSE 'unknown' END AS visibility FROM lookups)"""

FRAMES["visible"] = """
SELECT entity_id, name, maps_place, maps_review_count, lat, lng,
  CASE WHEN maps > visibility OR (visibility = 'unknown' AND maps IS NOT NULL) THEN maps ELSE visibility END AS visibility,
  CASE WHEN maps > visibility OR (visibility = 'unknown' AND maps IS NOT NULL) THEN concat('on the place list as ', maps_place, CASE WHEN maps_review_count IS NULL
    THEN ' (review count not recorded)' ELSE concat(' with ', maps_review_count, ' review(s)') END) ELSE visibility_reason END AS visibility_reason
FROM (SELECT *, CASE WHEN maps_place IS NOT NULL THEN CASE WHEN maps_review_count >= 1000 THEN 'V3' WHEN maps_review_count >= 100 THEN 'V2' ELSE 'V1' END END AS maps FROM visible_lookup)"""

FRAMES["gem_candidates"] = """
SELECT e.entity_id, e.canonical_name, e.entity_type, n_mentions, n_reviews FROM (SELECT entity_id, canonical_name, entity_type FROM entities WHERE entity_type = 'PLACE') e
JOIN (SELECT entity_id, CAST(sum(m) AS BIGINT) AS n_mentions, count(*) AS n_reviews FROM entity_reviews GROUP BY 1 HAVING count(*) >= 2) USING (entity_id)"""

FRAMES["recency"] = """
SELECT entity_id, avg((review_date >= (SELECT max(review_date) - INTERVAL 36 MONTH FROM host_reviews))::INT::DOUBLE) AS term_recency,
  count(DISTINCT source) AS n_sources, count(DISTINCT year(review_date)) AS n_years FROM entity_reviews JOIN host_reviews USING (review_id) GROUP BY 1"""

FRAMES["word_weights"] = """
SELECT DISTINCT w AS word, (length(w) % 5 - 2)::DOUBLE AS weight FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)"""

FRAMES["sentence_uses"] = "SELECT entity_id, sentence AS s, count(*) AS times FROM mentions WHERE trim(sentence) <> '' GROUP BY 1, 2"

FRAMES["sentiment"] = """
SELECT entity_id, (sum(c * times) / sum(times) + 1) / 2 AS term_sentiment, CAST(sum(times) AS BIGINT) AS n_sentiment_sentences
FROM (SELECT entity_id, times, coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15) AS c FROM sentence_uses LEFT JOIN (
  SELECT s, sum(weight) AS x FROM (SELECT s, unnest(regexp_extract_all(lower(s), '[\\p{L}'']+')) AS w FROM (SELECT DISTINCT s FROM sentence_uses)) JOIN word_weights ON w = word GROUP BY 1) USING (s)) GROUP BY 1"""

FRAMES["tf_docs"] = """
SELECT concat('r', review_id) AS doc, concat_ws(' ', source, place_name, detected_language) AS text FROM host_reviews
UNION ALL SELECT concat('m', mention_id), sentence FROM mentions"""

FRAMES["tf_counts"] = """
SELECT doc, term, count(*) AS c FROM (SELECT doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM tf_docs) WHERE term NOT IN ('the', 'and', 'of') GROUP BY 1, 2"""

FRAMES["tf_raw"] = """
SELECT doc, term, (1 + ln(c)) * (ln((1 + (SELECT count(*) FROM tf_docs))::DOUBLE / (1 + df)) + 1) AS w FROM tf_counts JOIN (SELECT term, count(*) AS df FROM tf_counts GROUP BY 1) USING (term)"""

FRAMES["tf_rows"] = "SELECT doc, term, w / norm AS w FROM tf_raw JOIN (SELECT doc, sqrt(sum(w * w)) AS norm FROM tf_raw GROUP BY 1) USING (doc)"

FRAMES["tf_centres"] = """
SELECT place_name, term, sum(w) AS cw FROM tf_rows JOIN (SELECT concat('r', review_id) AS doc, place_name FROM host_reviews) USING (doc) GROUP BY 1, 2"""

FRAMES["distinct_terms"] = """
SELECT entity_id, avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - coalesce(d / n_rows / clen, 0)))) AS term_distinct FROM
 (SELECT concat('m', mention_id) AS doc, entity_id, h.place_name FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id) x
 JOIN (SELECT place_name, n_rows, sqrt(sum((cw / n_rows) * (cw / n_rows))) AS clen FROM tf_centres JOIN (SELECT place_name, count(*) AS n_rows FROM host_reviews GROUP BY 1) USING (place_name) GROUP BY 1, 2) USING (place_name)
 LEFT JOIN (SELECT r.doc, sum(r.w * c.cw) AS d FROM tf_rows r JOIN (SELECT concat('m', mention_id) AS doc, h.place_name FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id) k ON k.doc = r.doc
   JOIN tf_centres c ON c.place_name = k.place_name AND c.term = r.term GROUP BY 1) USING (doc) GROUP BY 1"""

FRAMES["gem_terms"] = """
SELECT g.*, coalesce(r.n_sources, 0) AS n_sources, coalesce(r.n_years, 0) AS n_years, coalesce(v.visibility, 'unknown') AS visibility, least(1.0::DOUBLE, n_reviews / 10.0::DOUBLE) AS term_mentions,
  CASE v.visibility WHEN 'V0' THEN 1.0::DOUBLE WHEN 'V1' THEN 0.65::DOUBLE WHEN 'V2' THEN 0.30::DOUBLE WHEN 'V3' THEN 0.0::DOUBLE END AS term_hidden,
  d.term_distinct, s.term_sentiment, r.term_recency, coalesce(s.n_sentiment_sentences, 0) AS n_sentiment_sentences
FROM gem_candidates g LEFT JOIN visible v USING (entity_id) LEFT JOIN recency r USING (entity_id) LEFT JOIN sentiment s USING (entity_id) LEFT JOIN distinct_terms d USING (entity_id)"""


def even(x: str, digits: int) -> str:
    """Half-even rounding of ``x`` in exact decimals."""
    q = f"CAST({x} AS DECIMAL(18, 9)) * 1{'0' * digits}"
    up = f"({q}) - floor({q}) > 0.5 OR (({q}) - floor({q}) = 0.5 AND floor({q}) % 2 = 1)"
    return f"(CAST(floor({q}) + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 1{'0' * digits})"


WEIGHTS = [("mentions", 0.30), ("hidden", 0.30), ("distinct", 0.15), ("sentiment", 0.15), ("recency", 0.10)]


def score_sql(without: str = "") -> str:
    live = [(t, w) for t, w in WEIGHTS if t != without]
    top = " + ".join(f"coalesce(term_{t} * {w}::DOUBLE, 0)" for t, w in live)
    weight = " + ".join(f"CASE WHEN term_{t} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for t, w in live)
    return even(f"(({top}) / ({weight}))", 4)


FRAMES["scored_gems"] = f"""
SELECT entity_id, canonical_name, entity_type, {score_sql()} AS gem_score, n_reviews, n_mentions, n_sources, n_years, visibility, visibility = 'V3' AS already_official,
  {', '.join(f"{even('term_' + t, 4)} AS term_{t}" for t, _ in WEIGHTS)},
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN term_{t} IS NOT NULL THEN '{t}' END" for t, _ in WEIGHTS)}], lambda x: x IS NOT NULL)), '|') AS terms_used, n_sentiment_sentences
FROM gem_terms"""

FRAMES["decision_log"] = """
SELECT event_id AS log_order, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS decided_at_utc, concat('PLACE/', lower(concat(p_name, ' ', p_brand))) AS entity_id,
  CASE event_type WHEN 'signup' THEN 'verified' WHEN 'error' THEN 'rejected' ELSE 'sensitive' END AS state, concat('officer ', user_id % 3) AS decided_by, props AS reason
FROM events JOIN part ON p_partkey = user_id WHERE event_type IN ('signup', 'error', 'click') AND p_type IN ('MEDIUM', 'LARGE')"""

FRAMES["states"] = """
SELECT entity_id, state, decided_by, decided_at_utc, reason FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY decided_at_utc DESC, log_order DESC) AS rn FROM decision_log) WHERE rn = 1"""

FRAMES["queue_rows"] = """
SELECT g.entity_id, g.canonical_name, g.entity_type, g.gem_score, g.visibility, g.n_reviews, g.n_mentions, coalesce(s.state, 'candidate') AS state, coalesce(s.state, 'candidate') = 'verified' AS publishable,
  s.decided_by, s.decided_at_utc, s.reason, coalesce(e.divisions, '') AS divisions, coalesce(e.n, 0) AS n_evidence, coalesce(e.sentence, '') AS example_evidence, coalesce(e.place, '') AS example_found_in
FROM scored_gems g LEFT JOIN states s USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT found_in_division)), '|') AS divisions,
  min_by(sentence, mention_id) AS sentence, min_by(found_in_place, mention_id) AS place FROM evidence GROUP BY 1) e USING (entity_id)"""

FRAMES["attributes"] = """
SELECT a.place_name, a.district, a.division, a.entity_type, a.entity_id, e.canonical_name AS name, a.n_reviews, a.n_mentions, first_year, last_year, n_recent_reviews, example_review_id, example_sentence, example_year FROM (
SELECT place_name, district, division, entity_type, entity_id, count(DISTINCT review_id) AS n_reviews, count(*) AS n_mentions, CAST(min(y) AS INTEGER) AS first_year, CAST(max(y) AS INTEGER) AS last_year,
  count(DISTINCT CASE WHEN recent THEN review_id END) AS n_recent_reviews, arg_min(review_id, k) AS example_review_id, arg_min(sentence, k) AS example_sentence, CAST(arg_min(y, k) AS INTEGER) AS example_year
FROM (SELECT *, {'a': any_long AND len < 20, 'b': any_recent_pick AND NOT recent, 'c': abs(len - 120), 'd': review_id, 'e': sentence} AS k FROM (
  SELECT *, bool_or(len >= 20) OVER w AS any_long, CASE WHEN bool_or(len >= 20) OVER w THEN bool_or(len >= 20 AND recent) OVER w ELSE bool_or(recent) OVER w END AS any_recent_pick FROM (
    SELECT m.entity_type, m.entity_id, m.review_id, m.sentence, length(m.sentence) AS len, h.place_name, h.district, h.division, year(h.review_date) AS y,
      h.review_date >= (SELECT max(review_date) - INTERVAL 36 MONTH FROM host_reviews) AS recent FROM mentions m JOIN host_reviews h ON h.review_id = m.review_id WHERE m.entity_type <> 'PLACE')
  WINDOW w AS (PARTITION BY place_name, entity_id))) GROUP BY 1, 2, 3, 4, 5) a LEFT JOIN entities e ON e.entity_id = a.entity_id"""

FRAMES["specialities"] = """
SELECT entity_id, name, district, division, r AS reviews_in_district, total AS reviews_total, round_even(r::DOUBLE / total, 3) AS share, n_places, example_sentence FROM (
SELECT *, CAST(sum(r) OVER (PARTITION BY entity_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY entity_id ORDER BY r DESC, district) AS rn FROM (
  SELECT entity_id, name, district, division, CAST(sum(n_reviews) AS BIGINT) AS r, count(DISTINCT place_name) AS n_places,
    arg_min(example_sentence, {'n': -n_reviews, 'p': place_name}) AS example_sentence FROM attributes WHERE entity_type = 'FOOD' GROUP BY 1, 2, 3, 4))
WHERE rn = 1 AND total >= 3 AND r::DOUBLE / total >= 0.6"""

FRAMES["links"] = """
SELECT place_a, place_b, count(*) AS n_reviews, count(*) FILTER (f) AS n_found_in, count(*) FILTER (t) AS n_together, min(review_id) AS example_review_id, arg_min(ex, review_id) AS example_sentence FROM (
SELECT place_a, place_b, review_id, bool_or(hosted) AS f, bool_or(NOT hosted) AS t, arg_min(ex, {'h': NOT hosted, 'e': ex}) AS ex FROM (
  SELECT review_id, least(host, name) AS place_a, greatest(host, name) AS place_b, sentence AS ex, true AS hosted FROM named WHERE host <> name
  UNION ALL SELECT a.review_id, a.name, b.name, a.sentence, false FROM named a JOIN named b ON a.review_id = b.review_id AND a.name < b.name) GROUP BY 1, 2, 3)
GROUP BY 1, 2 HAVING count(*) >= 2"""

FRAMES["named"] = """
SELECT m.review_id, e.canonical_name AS name, h.host, max(m.sentence) AS sentence FROM mentions m JOIN entities e ON e.entity_id = m.entity_id
JOIN (SELECT review_id, CASE WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN lower(concat(p_name, ' ', p_brand)) ELSE lower(place_name) END AS host
      FROM host_reviews LEFT JOIN part ON p_partkey = CAST(review_id AS BIGINT) % 100) h ON h.review_id = m.review_id
WHERE m.entity_type = 'PLACE' AND h.host IS NOT NULL GROUP BY 1, 2, 3"""


def with_frames(sql: str) -> str:
    """Prefix ``sql`` with the frames it names, each after the frames it needs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in FRAMES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                need(FRAMES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    body = ",\n".join(f"{n} AS MATERIALIZED ({FRAMES[n].strip()})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"
