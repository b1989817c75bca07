"""Operational metrics over the request log, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.cluster import scratch_path
from lexispark.operators import events as ev
from lexispark.plans.registry import query
from lexispark.sources.tables import table

_E = """one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, ts) AS copy FROM request_events WHERE id IS NOT NULL),
e AS (SELECT * REPLACE (regexp_replace(lower(trim(endpoint)), '/+$', '') AS endpoint), CASE WHEN CAST(total_ms AS VARCHAR) <> 'nan' AND total_ms >= 0 THEN total_ms END AS ms FROM one WHERE copy = 1)"""


def _clean(spark, folder):
    return ev.clean_events(table(spark, folder, "request_events"))


@query(f"""WITH {_E} SELECT endpoint, count(*) AS requests, round(coalesce(avg(CASE WHEN status <> 'rejected' THEN ms END), 0), 6) AS avg_ms,
round(avg(CASE WHEN status <> 'degraded' THEN CAST(abstained AS INTEGER) END), 6) AS abstain_rate, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in,
CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, round(coalesce(sum(est_cost_usd), 0), 6) AS cost FROM e GROUP BY endpoint""")
def events_summary(spark, folder):
    """Requests, latency, abstain rate, tokens and cost per endpoint."""
    out = ev.summary(_clean(spark, folder))
    return out.select("endpoint", "requests", F.round("avg_ms", 6).alias("avg_ms"), F.round("abstain_rate", 6).alias("abstain_rate"), "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"))


@query(f"""WITH {_E} SELECT endpoint, count(ms) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99
FROM e WHERE status <> 'rejected' AND ms IS NOT NULL GROUP BY endpoint""")
def latency_nearest_rank(spark, folder):
    """Nearest-rank percentiles per endpoint."""
    return ev.latency_percentiles(_clean(spark, folder))


@query(f"WITH {_E} SELECT endpoint, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM e WHERE ms IS NOT NULL GROUP BY endpoint")
def latency_interpolated(spark, folder):
    """Interpolated percentiles per endpoint."""
    out = ev.latency_interpolated(_clean(spark, folder))
    return out.select("endpoint", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"""WITH {_E}, r AS (SELECT * FROM e WHERE status <> 'rejected' ORDER BY id DESC LIMIT {ev.RECENT}) SELECT count(*) AS n, min(id) AS first_id, quantile_disc(ms, 0.95) AS p95 FROM r""")
def recent_p95(spark, folder):
    """95th percentile over the last ten thousand requests."""
    rows = ev.recent_rows(_clean(spark, folder)).select("id", ev.duration(F.col("total_ms")).alias("v"))
    whole = rows.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sort_array(F.collect_list("v")).alias("vs"))  # at most RECENT values
    place = F.greatest(F.ceil(F.size("vs") * F.lit(0.95) - 1e-9), F.lit(1)).cast("int")
    return whole.select("n", "first_id", F.try_element_at("vs", place).alias("p95"))


def _bucket_sql(bounds) -> str:
    return "(VALUES " + ", ".join(f"({float(b)})" for b in bounds) + ", (NULL)) AS b(le)"


_HISTOGRAM = f"""WITH {_E}, h AS (SELECT endpoint, le, count(CASE WHEN le IS NULL OR s <= le THEN 1 END) AS n
FROM (SELECT endpoint, ms / 1000 AS s FROM e WHERE status <> 'rejected' AND ms IS NOT NULL), {_bucket_sql(ev.REQUEST_BOUNDS)} GROUP BY endpoint, le)"""


def _latency_buckets(spark, folder):
    ms = ev.duration(F.col("total_ms"))
    rows = _clean(spark, folder).where("status <> 'rejected'").select("endpoint", (ms / 1000).alias("s"))
    return ev.histogram(rows, ["endpoint"], "s", ev.REQUEST_BOUNDS)


@query(f"{_HISTOGRAM} SELECT endpoint, le, n FROM h")
def latency_histogram(spark, folder):
    """Cumulative latency buckets per endpoint."""
    return _latency_buckets(spark, folder)


@query(f"""{_HISTOGRAM}, o AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY endpoint) AS total FROM h WINDOW w AS (PARTITION BY endpoint ORDER BY le NULLS LAST))
SELECT endpoint, round(coalesce(min(CASE WHEN n >= total * 0.95 AND le IS NOT NULL AND n > before AND before < total * 0.95 THEN low + (le - low) * (total * 0.95 - before) / (n - before) END), max(le)), 6) AS value FROM o GROUP BY endpoint""")
def histogram_p95(spark, folder):
    """95th percentile interpolated from the buckets."""
    return ev.histogram_quantile(_latency_buckets(spark, folder), ["endpoint"], 0.95).select("endpoint", F.round("value", 6).alias("value"))


@query(f"""WITH {_E}, s AS (SELECT score_scale, top_score FROM e WHERE top_score IS NOT NULL AND NOT isnan(top_score) AND score_scale = 'hybrid-bm25')
SELECT score_scale, le, count(CASE WHEN le IS NULL OR top_score <= le THEN 1 END) AS n FROM s, {_bucket_sql(ev.BM25_SCORE_BOUNDS)} GROUP BY ALL""")
def score_histogram(spark, folder):
    """Cumulative buckets of BM25 scores; other scales never share them."""
    rows = _clean(spark, folder).where("score_scale = 'hybrid-bm25'")
    return ev.histogram(rows, ["score_scale"], "top_score", ev.BM25_SCORE_BOUNDS)


@query(f"""WITH {_E} SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, endpoint, count(*) AS requests, count(CASE WHEN abstained THEN 1 END) AS abstained,
round(coalesce(sum(CASE WHEN status <> 'rejected' THEN ms END), 0), 3) AS total_ms FROM e GROUP BY ALL""")
def rates_tumbling(spark, folder):
    """Hourly requests, abstentions and latency per endpoint."""
    out = ev.window_counts(_clean(spark, folder), "1 hour")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "endpoint", "requests", "abstained", F.round(F.coalesce("total_ms", F.lit(0.0)), 3).alias("total_ms"))


@query(f"""WITH {_E}, x AS (SELECT endpoint, abstained, (CAST(floor(epoch(ts) / 300) AS BIGINT) - unnest(range(0, 3))) * 300 AS window_start FROM e)
SELECT window_start, endpoint, count(*) AS requests, count(CASE WHEN abstained THEN 1 END) AS abstained FROM x GROUP BY ALL""")
def rates_sliding(spark, folder):
    """Requests in windows of fifteen minutes that begin every five."""
    out = ev.window_counts(_clean(spark, folder), "15 minutes", "5 minutes")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "endpoint", "requests", "abstained")


@query(f"""WITH {_E}, g AS (SELECT query_sha256, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY query_sha256 ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WHERE query_sha256 IS NOT NULL),
s AS (SELECT query_sha256, ts, sum(fresh) OVER (PARTITION BY query_sha256 ORDER BY ts) AS k FROM g)
SELECT query_sha256, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1800000000 AS session_end, count(*) AS requests FROM s GROUP BY query_sha256, k""")
def query_sessions(spark, folder):
    """Sessions of each query: requests less than thirty minutes apart."""
    out = ev.batch_sessions(_clean(spark, folder), "query_sha256")
    return out.select("query_sha256", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "requests")


_REASON = """CASE WHEN status = 'degraded' THEN 'degraded' WHEN NOT coalesce(abstained, false) THEN NULL WHEN json_extract_string(detail, '$.gate2.demoted') = 'true' THEN 'gate2_demote'
WHEN json_extract_string(detail, '$.gate1.passed') = 'false' THEN 'gate1' ELSE 'threshold' END"""


@query(f"WITH {_E}, r AS (SELECT {_REASON} AS reason FROM e) SELECT reason, count(*) AS requests FROM r WHERE reason IS NOT NULL GROUP BY reason")
def abstain_reasons(spark, folder):
    """Requests not answered, by reason."""
    return ev.abstain_counts(_clean(spark, folder))


@query(f"""WITH {_E}, d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(CASE WHEN abstained THEN 1 END) AS a, count(abstained) AS n, count(CASE WHEN honest_miss THEN 1 END) AS h, count(honest_miss) AS hn FROM e WHERE endpoint = '/ask' GROUP BY 1)
SELECT day, round(a / nullif(n, 0), 6) AS abstain_rate, round(h / nullif(hn, 0), 6) AS honest_miss_rate FROM d""")
def daily_ratios(spark, folder):
    """Daily abstain and honest-miss rates of answers; a day without any has null."""
    rate = lambda c: F.round(F.count_if(c) / F.nullif(F.count(c), F.lit(0)), 6)
    day = F.floor(F.unix_seconds("ts") / 86400).alias("day")
    return _clean(spark, folder).where("endpoint = '/ask'").groupBy(day).agg(rate("abstained").alias("abstain_rate"), rate("honest_miss").alias("honest_miss_rate"))


@query(f"""WITH {_E} SELECT pipeline, count(*) AS n, round(avg(CAST(json_extract_string(detail, '$.stages.text_bm25') AS DOUBLE)), 6) AS bm25_ms,
count(json_extract_string(detail, '$.threshold')) AS with_threshold FROM e GROUP BY pipeline""")
def detail_stages(spark, folder):
    """Stage timings out of the JSON detail."""
    at = lambda p: F.get_json_object("detail", p)
    return _clean(spark, folder).groupBy("pipeline").agg(
        F.count("*").alias("n"), F.round(F.avg(at("$.stages.text_bm25").cast("double")), 6).alias("bm25_ms"), F.count(at("$.threshold")).alias("with_threshold")
    )


@query(f"""WITH {_E}, w AS (SELECT query_sha256, id, count(*) OVER (PARTITION BY query_sha256 ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM e WHERE query_sha256 IS NOT NULL)
SELECT in_window, count(*) AS requests FROM w GROUP BY in_window""")
def recent_request_counts(spark, folder):
    """How many requests of the same query fell into the minute before each."""
    out = ev.recent_requests(_clean(spark, folder), "query_sha256")
    return out.groupBy("in_window").agg(F.sum("n").alias("requests"))


@query(f"""WITH {_E}, b AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, epoch_us(ts) AS t0, epoch_us(ts) + CAST(round(ms * 1000) AS BIGINT) AS t1 FROM e WHERE ms IS NOT NULL),
x AS (SELECT day, t0 AS t, 1 AS d FROM b UNION ALL SELECT day, t1, -1 FROM b), r AS (SELECT day, sum(d) OVER (PARTITION BY day ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM x)
SELECT day, CAST(max(n) AS BIGINT) AS most FROM r GROUP BY day""")
def in_flight(spark, folder):
    """Most requests at work at once per day."""
    return ev.in_flight(_clean(spark, folder)).select(F.unix_date("day").cast("long").alias("day"), "most")


@query(f"""WITH {_E} SELECT pipeline, round(corr(query_len, top_score), 6) AS len_score, round(corr(query_len, encode_ms), 6) AS len_encode FROM e
WHERE top_score IS NOT NULL AND NOT isnan(top_score) AND encode_ms IS NOT NULL AND NOT isnan(encode_ms) GROUP BY pipeline HAVING count(*) > 1""")
def length_correlations(spark, folder):
    """Correlation of query length with score and encoding time."""
    rows = _clean(spark, folder).where("top_score is not null and not isnan(top_score) and encode_ms is not null and not isnan(encode_ms)")
    return rows.groupBy("pipeline").agg(
        F.round(F.corr("query_len", "top_score"), 6).alias("len_score"), F.round(F.corr("query_len", "encode_ms"), 6).alias("len_encode"), F.count("*").alias("n")
    ).where("n > 1").drop("n")


@query(f"""WITH {_E} SELECT score_scale, index_revision, coalesce(error_type, 'none') AS error_type, count(*) AS requests FROM e GROUP BY ALL""")
def request_counters(spark, folder):
    """Counters by scale, index revision and error."""
    return _clean(spark, folder).groupBy("score_scale", "index_revision", F.coalesce("error_type", F.lit("none")).alias("error_type")).agg(F.count("*").alias("requests"))


@query(f"""WITH {_E} SELECT id, round(tokens_in / 1e6 * 0.10 + tokens_out / 1e6 * 0.40, 9) AS cost, round(CASE WHEN answer_ms > 0 AND NOT isnan(answer_ms) THEN tokens_out / (answer_ms / 1000) END, 6) AS tokens_per_s FROM e""")
def token_costs(spark, folder):
    """Cost and speed of every answer; null where a part is unknown."""
    from lexispark.operators.answering import token_cost

    ms = F.col("answer_ms")
    return _clean(spark, folder).select(
        "id", F.round(token_cost(F.col("tokens_in"), F.col("tokens_out")), 9).alias("cost"),
        F.round(F.when((ms > 0) & ~F.isnan(ms), F.col("tokens_out") / (ms / 1000)), 6).alias("tokens_per_s"),
    )


def _stream(spark, folder):
    from lexispark.streaming import requests

    schema = table(spark, folder, "request_events").schema
    # a pattern, since a table may be one file or a folder of them
    return requests.read_requests(spark, f"{folder}/request_events.parquet*", schema)


@query(f"""WITH {_E} SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, endpoint, count(*) AS requests, count(CASE WHEN abstained THEN 1 END) AS abstained FROM e GROUP BY ALL""")
def stream_hourly(spark, folder):
    """Hourly counts computed as a stream with de-duplication under a watermark; equals the batch result."""
    from lexispark.streaming import requests

    base = scratch_path(spark, "hourly")
    requests.run_once(requests.windowed(_stream(spark, folder)), f"{base}/out", f"{base}/state", mode="complete")
    return spark.read.parquet(f"{base}/out").select(F.unix_seconds("window_start").alias("window_start"), "endpoint", "requests", "abstained")


@query(f"""WITH RECURSIVE {_E}, x AS (SELECT query_sha256 AS c, id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY query_sha256 ORDER BY epoch_us(ts), id) AS k FROM e WHERE query_sha256 IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT c, id, us, k FROM x WHERE k = 1 UNION ALL SELECT n.c, n.id, n.us, n.k FROM f, LATERAL (SELECT * FROM x WHERE x.c = f.c AND x.us >= f.us + 600000000 ORDER BY k LIMIT 1) n),
w AS (SELECT f.id IS NOT NULL AS admitted, CASE WHEN f.id IS NULL THEN greatest(1, 600 - (x.us - max(f.us) OVER (PARTITION BY x.c ORDER BY x.k)) / 1e6) ELSE 0 END AS wait FROM x LEFT JOIN f ON f.c = x.c AND f.k = x.k)
SELECT admitted, count(*) AS requests, round(max(wait), 3) AS longest_wait FROM w GROUP BY admitted""")
def stream_limiter(spark, folder):
    """Admissions of the sliding-window limiter with the query as client, one in ten minutes, computed as a stream."""
    from lexispark.streaming import requests

    base = scratch_path(spark, "limiter")
    requests.run_once(requests.limited(requests.deduplicated(_stream(spark, folder)), "query_sha256", 1, 600), f"{base}/out", f"{base}/state")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("admitted").agg(F.count("*").alias("requests"), F.round(F.max("retry_after"), 3).alias("longest_wait"))


_STAGES = """st AS (SELECT id, k AS stage, CAST(json_extract_string(detail, '$.stages.' || k) AS DOUBLE) AS ms FROM (SELECT id, detail, unnest(json_keys(detail, '$.stages')) AS k FROM e WHERE status <> 'rejected'))"""


@query(f"""WITH {_E}, {_STAGES} SELECT stage, le, count(CASE WHEN le IS NULL OR ms / 1000 <= le THEN 1 END) AS n FROM (SELECT * FROM st WHERE ms IS NOT NULL AND NOT isnan(ms) AND ms >= 0), {_bucket_sql(ev.STAGE_BOUNDS)} GROUP BY ALL""")
def stage_histogram(spark, folder):
    """Cumulative buckets of every stage's duration, out of the JSON detail."""
    return ev.histogram(ev.stage_durations(_clean(spark, folder)), ["stage"], "s", ev.STAGE_BOUNDS)


_SCALED = "coalesce(score_scale, 'none')"


@query(f"""WITH {_E}, s AS (SELECT {_SCALED} AS scale, margin_1_2 AS x FROM e WHERE margin_1_2 IS NOT NULL AND NOT isnan(margin_1_2) AND status <> 'rejected')
SELECT scale, le, count(CASE WHEN le IS NULL OR x <= le THEN 1 END) AS n FROM (SELECT * FROM s WHERE scale = 'hybrid-bm25'), {_bucket_sql(ev.BM25_MARGIN_BOUNDS)} GROUP BY ALL
UNION ALL SELECT scale, le, count(CASE WHEN le IS NULL OR x <= le THEN 1 END) FROM (SELECT * FROM s WHERE scale <> 'hybrid-bm25'), {_bucket_sql(ev.MARGIN_BOUNDS)} GROUP BY ALL""")
def margin_histogram(spark, folder):
    """Cumulative buckets of the margin, BM25's and the normalised scales each with their own bounds."""
    scale = F.coalesce("score_scale", F.lit("none"))
    rows = _clean(spark, folder).where("status <> 'rejected'").select(scale.alias("scale"), "margin_1_2")
    wide = ev.histogram(rows.where("scale = 'hybrid-bm25'"), ["scale"], "margin_1_2", ev.BM25_MARGIN_BOUNDS)
    return wide.unionByName(ev.histogram(rows.where("scale <> 'hybrid-bm25'"), ["scale"], "margin_1_2", ev.MARGIN_BOUNDS))


@query(f"""WITH {_E}, s AS (SELECT endpoint, tokens_per_s AS x FROM e WHERE tokens_per_s IS NOT NULL AND NOT isnan(tokens_per_s))
SELECT endpoint, le, count(CASE WHEN le IS NULL OR x <= le THEN 1 END) AS n FROM s, {_bucket_sql(ev.SPEED_BOUNDS)} GROUP BY ALL""")
def speed_histogram(spark, folder):
    """Cumulative buckets of tokens a second."""
    return ev.histogram(_clean(spark, folder), ["endpoint"], "tokens_per_s", ev.SPEED_BOUNDS)


_ASKED = f"""asked AS (SELECT id, ts, endpoint, CASE WHEN http_status IN (422, 429) THEN 'rejected' WHEN status = 'ok' THEN 'answered' ELSE status END AS status, http_status, total_ms, coalesce(query_text, '') AS query,
    json_extract_string(detail, '$.hits[0].score') AS s0, json_extract_string(detail, '$.hits[1].score') AS s1, answer_ms, encode_ms, abstained, tokens_in, tokens_out, error_type FROM e)"""


@query(f"""WITH {_E}, {_ASKED} SELECT id, status, CASE WHEN status = 'rejected' THEN coalesce(CASE http_status WHEN 422 THEN 'unsearchable' WHEN 429 THEN 'rate_limited' END, 'other') ELSE error_type END AS error_type,
length(query) AS query_len, sha256(query) AS query_sha256, round(CASE WHEN status <> 'rejected' THEN CAST(s0 AS DOUBLE) END, 6) AS top_score,
round(CASE WHEN status <> 'rejected' THEN CAST(s0 AS DOUBLE) - CAST(s1 AS DOUBLE) END, 6) AS margin_1_2, CASE WHEN status <> 'rejected' THEN abstained END AS abstained,
round(CASE WHEN status <> 'rejected' AND answer_ms > 0 AND NOT isnan(answer_ms) THEN tokens_out / (answer_ms / 1000) END, 6) AS tokens_per_s,
round(CASE WHEN status <> 'rejected' THEN tokens_in / 1e6 * 0.10 + tokens_out / 1e6 * 0.40 END, 9) AS est_cost_usd FROM asked""")
def event_rows(spark, folder):
    """Event rows built from what the log knows of each request: hits and stages out of the detail, the rest recomputed."""
    log = _clean(spark, folder)
    hits = F.coalesce(F.from_json(F.get_json_object("detail", "$.hits"), "array<struct<page_id:string,score:double>>"), F.array().cast("array<struct<page_id:string,score:double>>"))
    measured = F.map_filter(F.create_map(F.lit("query_encode"), F.col("encode_ms"), F.lit("answerer"), F.col("answer_ms")), lambda k, v: v.isNotNull() & ~F.isnan(v))
    status = F.when(F.col("http_status").isin(422, 429), "rejected").when(F.col("status") == "ok", "answered").otherwise(F.col("status"))
    requests = log.select(
        "id", "ts", "endpoint", status.alias("status"), "http_status", "total_ms", F.coalesce("query_text", F.lit("")).alias("query"), hits.alias("hits"), measured.alias("stages"),
        F.lit(None).cast("string").alias("answer_text"), "abstained", "tokens_in", "tokens_out", "error_type",
    )
    rows = ev.event_rows(requests)
    return rows.select(
        "id", "status", "error_type", "query_len", "query_sha256", *[F.round(c, 6).alias(c) for c in ("top_score", "margin_1_2", "tokens_per_s")], "abstained", F.round("est_cost_usd", 9).alias("est_cost_usd")
    )


@query(f"""WITH {_E}, n AS (SELECT id, 1 AS seq, 'status' AS name, status AS value FROM e UNION ALL SELECT id, 2, 'error', coalesce(error_type, 'none') FROM e UNION ALL SELECT id, 3, 'status', 'late-' || endpoint FROM e WHERE received_at > ts + INTERVAL 1 HOUR)
SELECT id, arg_max(CASE WHEN name = 'status' THEN value END, seq) AS status, max(CASE WHEN name = 'error' THEN value END) AS error FROM n GROUP BY id""")
def merged_notes(spark, folder):
    """Notes of a request merged, the last of one name holding."""
    log = _clean(spark, folder)
    note = lambda df, seq, name, value: df.select(F.col("id").alias("request_id"), F.lit(seq).alias("seq"), F.lit(name).alias("name"), value.alias("value"))
    late = log.where(F.col("received_at") > F.col("ts") + F.expr("interval 1 hour"))
    notes = note(log, 1, "status", F.col("status")).unionByName(note(log, 2, "error", F.coalesce("error_type", F.lit("none")))).unionByName(note(late, 3, "status", F.concat(F.lit("late-"), "endpoint")))
    return ev.merge_notes(notes).select(F.col("request_id").alias("id"), F.col("notes")["status"].alias("status"), F.col("notes")["error"].alias("error"))
