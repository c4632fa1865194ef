"""SQL counterparts of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

from larkspur.functions.text import STOP_WORDS, preprocess_query

#: The search that the ranking queries run.
QUERY = "Open source database engine for students: fast parallel queue"

_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NORMAL = f"regexp_replace(lower(text), '[^a-z{_WS}]', '', 'g')"
_TOKENS = f"list_filter(regexp_split_to_array({_NORMAL}, '[{_WS}]+'), lambda w: w <> '')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

_CORPUS = """
corpus AS (
  SELECT id, any_value(title) AS title, any_value(text) AS text, any_value(preprocessed_text) AS preprocessed_text,
         any_value(url) AS url, any_value(score) AS score
  FROM stories WHERE id IS NOT NULL GROUP BY id
)"""

_STORY_ITEMS = """
items AS (
  SELECT * FROM crawl_items WHERE type = 'story' AND id IS NOT NULL AND title IS NOT NULL AND score IS NOT NULL
), projected AS (
  SELECT arrival_no, id, title, title || ' ' || coalesce(text, '') AS text, coalesce(url, '') AS url, score FROM items
)"""

_INDEX = rf"""
{_CORPUS}, counts AS (
  SELECT id, term, count(*) AS tf
  FROM (SELECT id, unnest(regexp_extract_all(coalesce(preprocessed_text, ''), '\b\w\w+\b')) AS term FROM corpus)
  GROUP BY id, term
), terms AS (
  SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM counts GROUP BY term
), raws AS (SELECT id, term, tf * idf AS raw FROM counts JOIN terms USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raws)"""

_WANTED = ", ".join(f"('{w}')" for w in preprocess_query(QUERY).split())

_SPARSE = f"""
{_INDEX}, asked AS (
  SELECT term, count(*) * any_value(idf) AS raw FROM (VALUES {_WANTED}) AS q(term) JOIN terms USING (term) GROUP BY term
), unit AS (SELECT term, raw / sqrt(sum(raw * raw) OVER ()) AS w FROM asked),
sparse AS (
  SELECT id, coalesce(s, 0) AS score FROM corpus
  LEFT JOIN (SELECT id, round(sum(weight * w), 10) AS s FROM weights JOIN unit USING (term) GROUP BY id) USING (id)
)"""

_DENSE = """
usable AS (
  SELECT id, any_value(embedding)::DOUBLE[] AS v FROM story_vectors WHERE id IS NOT NULL AND embedding IS NOT NULL GROUP BY id
), lengths AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM usable),
query AS (SELECT v AS qv, n AS qn FROM lengths WHERE n > 0 ORDER BY id LIMIT 1),
dense AS (
  SELECT id, CASE WHEN n > 0 THEN round(list_inner_product(v, qv) / (n * qn), 10) ELSE 0 END AS score FROM lengths, query
)"""

_FUSED = f"""
WITH {_SPARSE}, {_DENSE},
t AS (SELECT id, score AS tfidf_score, row_number() OVER (ORDER BY score DESC, id DESC) AS tfidf_rank FROM sparse QUALIFY tfidf_rank <= 20),
v AS (SELECT id, score AS vector_score, row_number() OVER (ORDER BY score DESC, id DESC) AS vector_rank FROM dense QUALIFY vector_rank <= 20),
found AS (
  SELECT id, coalesce(tfidf_score, 0) AS tfidf_score, coalesce(vector_score, 0) AS vector_score, tfidf_rank, vector_rank
  FROM t FULL JOIN v USING (id)
), fused AS (SELECT *, round(0.4::DOUBLE * tfidf_score + 0.6::DOUBLE * vector_score, 10) AS final_score FROM found),
ranked AS (
  SELECT id, final_score, row_number() OVER (ORDER BY final_score DESC, tfidf_rank NULLS LAST, vector_rank NULLS LAST) AS place FROM fused
)
"""

_LOG = "log AS (SELECT DISTINCT id, query, results_count, timestamp FROM search_analytics)"

_REQUESTS = """
requests AS (
  SELECT request_id, q, coalesce(page, 1) AS page, coalesce(page_size, 5) AS page_size, round(epoch * 1000000)::BIGINT AS us
  FROM search_requests
  WHERE q IS NOT NULL AND epoch IS NOT NULL AND coalesce(page, 1) >= 1 AND coalesce(page_size, 5) >= 1
), misses AS (
  SELECT q, page, page_size, min(us) AS us FROM requests GROUP BY ALL
  UNION
  SELECT m.q, m.page, m.page_size, min(r.us) FROM misses m
  JOIN requests r ON r.q = m.q AND r.page = m.page AND r.page_size = m.page_size AND r.us >= m.us + 3600000000
  GROUP BY m.q, m.page, m.page_size, m.us
), outcomes AS (
  SELECT r.*, CASE WHEN m.us IS NOT NULL AND row_number() OVER (PARTITION BY r.q, r.page, r.page_size, r.us ORDER BY request_id) = 1
    THEN 'miss' ELSE 'hit' END AS outcome
  FROM requests r LEFT JOIN misses m USING (q, page, page_size, us)
)"""

_WORDS = f"""
{_CORPUS}, placed AS (
  SELECT id, list_filter(regexp_split_to_array(lower(title), '[{_WS}]+'), lambda w: w <> '') AS ws FROM corpus WHERE title IS NOT NULL
), words AS (
  SELECT word, min(pos)::BIGINT AS pos
  FROM (SELECT unnest(ws) AS word, id * 1048576 + unnest(range(len(ws))) AS pos FROM placed) GROUP BY word
)"""

_TREE = f"""
{_WORDS}, prefixes AS (SELECT word, pos, unnest(range(1, length(word) + 1)) AS n FROM words),
minima AS (SELECT left(word, n) AS prefix, min(pos) AS least FROM prefixes GROUP BY prefix),
keys AS (
  SELECT word, list(least ORDER BY n) AS key FROM prefixes JOIN minima ON prefix = left(word, n) GROUP BY word
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "source_top_ids": """
            SELECT id, max(score) AS rank FROM crawl_items WHERE id IS NOT NULL GROUP BY id ORDER BY rank DESC NULLS LAST, id LIMIT 200""",
        "source_story_filter": f"WITH {_STORY_ITEMS} SELECT arrival_no, id, title, score FROM items",
        "story_projection": f"WITH {_STORY_ITEMS} SELECT * FROM projected",
        "keyword_filter": f"WITH {_CORPUS} SELECT id, title FROM corpus WHERE contains(lower(title), 'database')",
        "scan_stories": f"WITH {_CORPUS} SELECT * FROM corpus",
        "json_decode": "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events",
        "insert_if_absent": f"""
            WITH {_STORY_ITEMS} SELECT id, title, text, url, score FROM projected WHERE id NOT IN (SELECT id FROM stories WHERE id IS NOT NULL)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival_no) = 1""",
        "insert_meta": f"""
            WITH {_STORY_ITEMS} SELECT count(DISTINCT id) AS n_stories FROM projected WHERE id NOT IN (SELECT id FROM stories WHERE id IS NOT NULL)""",
        "search_log_append": f"""
            WITH RECURSIVE {_REQUESTS} SELECT q AS query, least(page * page_size, 40)::INTEGER AS results_count FROM outcomes WHERE outcome = 'miss'""",
        "text_normalize": f"SELECT doc_id, {_NORMAL} AS normalized FROM documents",
        "text_tokenize": f"SELECT doc_id, array_to_string({_TOKENS}, '|') AS tokens, len({_TOKENS}) AS n_tokens FROM documents",
        "stopword_removal": f"""
            SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda w: w NOT IN ({_STOPS})), ' ') AS kept FROM documents""",
        "preprocess_stored": rf"""
            SELECT DISTINCT id, trim(regexp_replace(preprocessed_text, '[{_WS}]+', ' ', 'g')) AS preprocessed_text
            FROM stories WHERE id IS NOT NULL AND preprocessed_text IS NOT NULL""",
        "tfidf_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 8) AS idf FROM terms",
        "tfidf_weights": f"WITH {_INDEX} SELECT id, term, round(weight, 8) AS weight FROM weights",
        "tfidf_scores": f"WITH {_SPARSE} SELECT id, round(score, 8) AS score FROM sparse",
        "tfidf_topk": f"WITH {_SPARSE} SELECT id, round(score, 8) AS score FROM sparse ORDER BY sparse.score DESC, id DESC LIMIT 10",
        "vector_scan": f"WITH {_DENSE} SELECT id, len(v) AS n_values FROM usable",
        "vector_scores": f"WITH {_DENSE} SELECT id, round(score, 6)::DOUBLE AS score FROM dense",
        "vector_topk": f"WITH {_DENSE} SELECT id, round(score, 6)::DOUBLE AS score FROM dense ORDER BY dense.score DESC, id DESC LIMIT 10",
        "hybrid_candidates": _FUSED
        + """SELECT id, round(tfidf_score, 6)::DOUBLE AS tfidf_score, round(vector_score, 6)::DOUBLE AS vector_score, tfidf_rank, vector_rank
             FROM found""",
        "hybrid_scores": _FUSED + "SELECT id, round(final_score, 6)::DOUBLE AS final_score FROM fused",
        "hybrid_topk": _FUSED + "SELECT place, id, round(final_score, 6)::DOUBLE AS final_score FROM ranked WHERE place <= 10",
        "search_page": _FUSED + "SELECT place, id, round(final_score, 6)::DOUBLE AS final_score FROM ranked WHERE place BETWEEN 6 AND 10",
        "search_page_meta": _FUSED
        + """SELECT 4 AS page, 10 AS page_size, count(*) AS total, ceil(count(*) / 10.0)::BIGINT AS total_pages FROM ranked WHERE place <= 40""",
        "page_buttons": _FUSED
        + """, meta AS (SELECT ceil(count(*) / 10.0)::INTEGER AS pages FROM ranked WHERE place <= 40)
             SELECT unnest(range(1, least(pages, 5) + 1))::INTEGER AS button, unnest(range(1, least(pages, 5) + 1)) = 4 AS is_current
             FROM meta WHERE pages > 1""",
        "result_card": _FUSED
        + """SELECT place, id, title, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS snippet,
                    CASE WHEN final_score <> 0 THEN printf('%.1f', round(final_score * 100, 1)) END AS score_label, url
             FROM ranked JOIN corpus USING (id) WHERE place <= 5""",
        "url_encoding": """
            SELECT DISTINCT q, replace(replace(replace(replace(replace(replace(url_encode(q), '+', '%20'),
              '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded
            FROM search_requests WHERE q IS NOT NULL""",
        "autocomplete_vocab": f"WITH {_WORDS} SELECT word, pos FROM words",
        "autocomplete": f"WITH {_TREE} SELECT word FROM keys WHERE starts_with(word, 'de') ORDER BY key LIMIT 10",
        "autocomplete_order": f"WITH {_TREE} SELECT word, array_to_string(key, ',') AS key FROM keys",
        "debounce_effective": """
            SELECT request_id, q FROM (
              SELECT request_id, q, round(epoch * 1000000)::BIGINT AS us,
                     lead(round(epoch * 1000000)::BIGINT) OVER (PARTITION BY ip ORDER BY round(epoch * 1000000)::BIGINT, request_id) AS following
              FROM search_requests WHERE epoch IS NOT NULL)
            WHERE (following IS NULL OR following - us >= 300000) AND trim(q) <> '' AND length(q) >= 2""",
        "top_searches": f"""
            WITH {_LOG} SELECT '#' || row_number() OVER (ORDER BY n DESC, query NULLS LAST) AS label, query, n AS count FROM
            (SELECT query, count(query) AS n FROM log GROUP BY query ORDER BY n DESC, query NULLS LAST LIMIT 10)""",
        "zero_searches": f"""
            WITH {_LOG} SELECT query, epoch_us(log.timestamp) AS timestamp, strftime(log.timestamp, '%Y-%m-%d') AS date FROM log WHERE results_count = 0
            ORDER BY log.timestamp DESC NULLS FIRST, id DESC LIMIT 20""",
        "rate_limit": """
            WITH timed AS (SELECT request_id, ip, round(epoch * 1000000)::BIGINT AS us FROM search_requests WHERE epoch IS NOT NULL),
            counted AS (
              SELECT request_id, ip,
                count(*) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING)
                + row_number() OVER (PARTITION BY ip, us ORDER BY request_id) - 1 AS prior
              FROM timed)
            SELECT request_id, ip, prior, CASE WHEN prior < 40 THEN 'allow' ELSE 'reject' END AS decision FROM counted""",
        "cache_effective": f"WITH RECURSIVE {_REQUESTS} SELECT request_id, outcome FROM outcomes",
    }
