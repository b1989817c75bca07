"""SQL for the queries that plain SQL can express over whole tables; the others are tested against brute force."""

_TIMINGS = """
WITH one AS (
    SELECT id, lower(trim(endpoint)) AS ep, pipeline, total_ms, answer_ms,
           row_number() OVER (PARTITION BY id ORDER BY received_at, ts) AS copy
    FROM request_events WHERE id IS NOT NULL),
timings AS (
    SELECT id, regexp_replace(ep, '/+$', '') AS endpoint, coalesce(pipeline, '(none)') AS pipeline, 'total_ms' AS metric, total_ms AS value
    FROM one WHERE copy = 1
    UNION ALL
    SELECT id, regexp_replace(ep, '/+$', ''), coalesce(pipeline, '(none)'), 'answer_ms', answer_ms FROM one WHERE copy = 1),
measured AS (SELECT * FROM timings WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND NOT isinf(value))
"""

_TOP = """
WITH pages AS (
    SELECT query_id, page_id, max(score) AS score FROM page_hits
    WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND page_id IS NOT NULL
    GROUP BY query_id, page_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS hit_rank FROM pages)
"""

SQL = {
    "p5_found": _TIMINGS
    + """, medians AS (SELECT endpoint, pipeline, metric, median(value) AS m FROM measured GROUP BY ALL)
SELECT id, metric FROM measured JOIN medians USING (endpoint, pipeline, metric) WHERE value > 5 * m""",
    "p6_found": _TOP + "SELECT query_id, hit_rank, page_id FROM ranked WHERE hit_rank <= 5",
    "p6_top_pages": _TOP + "SELECT query_id, hit_rank, page_id, score FROM ranked WHERE hit_rank <= 5",
}
