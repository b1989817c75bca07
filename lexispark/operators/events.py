"""Operational metrics over the request log, for batch frames and, where no window over all rows is needed, streams.

An ``id`` counts once (the copy received first); endpoints that differ in case or a closing slash are one; null, NaN and
negative durations are not measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.cluster import broadcast_if_small, running_sums
from lexispark.functions.text import honest_miss
from lexispark.operators.answering import abstain_reason, token_cost

# Histogram bounds (seconds, seconds, scores, margins, tokens a second), classes of rejections and the
# window of recent rows.
REQUEST_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1, 2, 4, 8, 15, 30, 45, 60)
STAGE_BOUNDS = (0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 20, 35, 60)
SCORE_BOUNDS = (0.30, 0.40, 0.45, 0.50, 0.55, 0.58, 0.60, 0.65, 0.70, 0.80)
BM25_SCORE_BOUNDS = (0, 5, 10, 10.6, 15, 20, 30, 45, 70, 100)
MARGIN_BOUNDS, BM25_MARGIN_BOUNDS = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08), (0, 0.5, 1, 2, 5, 10, 20, 40)
SPEED_BOUNDS = (5, 10, 20, 40, 80, 160)
REJECT_REASONS = {422: "unsearchable", 429: "rate_limited"}
RECENT = 10_000
LIMIT_WINDOW_SECONDS = 60


def clean_events(events: DataFrame) -> DataFrame:
    """One row per id, with one spelling of the endpoint."""
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("received_at"), "ts")
    one = events.where("id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return one.withColumn("endpoint", endpoint_form(F.col("endpoint")))


def endpoint_form(endpoint: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(endpoint)), "/+$", "")


def duration(ms: Column) -> Column:
    """A measured duration, else null."""
    return F.when(ms.isNotNull() & ~F.isnan(ms) & (ms >= 0), ms)


def summary(events: DataFrame) -> DataFrame:
    """Per endpoint: requests, mean latency without rejected ones, abstain rate without degraded ones, tokens, cost."""
    ms = F.when(F.col("status") != "rejected", duration(F.col("total_ms")))
    judged = F.when(F.col("status") != "degraded", F.col("abstained").cast("int"))
    return events.groupBy("endpoint").agg(
        F.count("*").alias("requests"),
        F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_ms"),
        F.avg(judged).alias("abstain_rate"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum("est_cost_usd"), F.lit(0.0)).alias("cost"),
    )


def _placed(values: DataFrame) -> DataFrame:
    """``endpoint``, ``v`` and its number ``k``, ``upto`` (how many are no larger) and ``n`` (how many there are)."""
    counts = values.groupBy("endpoint", "v").agg(F.count("*").alias("k"))
    size = counts.groupBy(F.col("endpoint").alias("_e")).agg(F.sum("k").alias("n"))  # a row an endpoint
    sums = running_sums(counts, ["endpoint"], [F.col("v")], ["k"]).withColumnRenamed("k_upto", "upto")
    return sums.join(broadcast_if_small(size), F.col("endpoint").eqNullSafe(F.col("_e"))).drop("_e")


def stage_durations(events: DataFrame) -> DataFrame:
    """``id``, ``stage``, ``s``: every stage of every request in the JSON detail, in seconds; what isn't a measured duration
    is left out."""
    stages = F.from_json(F.get_json_object("detail", "$.stages"), "map<string,double>")
    rows = events.where("status <> 'rejected'").select("id", F.explode(stages).alias("stage", "ms"))
    return rows.select("id", "stage", (duration(F.col("ms")) / 1000).alias("s")).where("s is not null")


def latency_percentiles(events: DataFrame, points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of the latency per endpoint, from counts by value."""
    ms = duration(F.col("total_ms"))
    ranked = _placed(events.where(F.col("status") != "rejected").select("endpoint", ms.alias("v")).where("v is not null"))
    return ranked.groupBy("endpoint").agg(
        F.first("n").alias("n"),
        *[F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n") * q - 1e-9), F.lit(1)), F.col("v"))).alias(f"p{round(q * 100)}") for q in points],
    )


def latency_interpolated(events: DataFrame, points: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Percentiles per endpoint interpolated between the two nearest values, from counts by value: no task holds the values
    of an endpoint."""
    ranked = _placed(events.select("endpoint", duration(F.col("total_ms")).alias("v")).where("v is not null"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    out = []
    for q in points:
        want = F.lit(float(q)) * (F.col("n") - 1)
        low, high, part = at(F.floor(want)), at(F.ceil(want)), F.first(want - F.floor(want))
        out.append((low + (high - low) * part).alias(f"p{round(q * 100)}"))
    return ranked.groupBy("endpoint").agg(*out)


def recent_rows(events: DataFrame, rows: int = RECENT) -> DataFrame:
    """The last rows by id that were not rejected: a top-k, so that no task sorts the table."""
    return events.where("status <> 'rejected'").orderBy(F.desc("id")).limit(rows)


def histogram(values: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound, the last one infinite (null): ``by``, ``le``, ``n``."""
    v = F.col(value)
    seen = values.where(v.isNotNull() & ~F.isnan(v))
    counts = seen.groupBy(*by).agg(*[F.count_if(v <= le).alias(f"_{i}") for i, le in enumerate(bounds)], F.count("*").alias("_all"))
    cells = [F.struct(F.lit(float(le)).alias("le"), F.col(f"_{i}").alias("n")) for i, le in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return counts.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.le", "c.n")


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """Quantile by linear interpolation within the bucket that holds it; the last finite bound if none does."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("le"))
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0)))
    rows = rows.withColumn("total", F.max("n").over(Window.partitionBy(*by)))
    want = F.col("total") * F.lit(float(q))
    at = F.col("low") + (F.col("le") - F.col("low")) * (want - F.col("before")) / (F.col("n") - F.col("before"))
    value = F.min(F.when((F.col("n") >= want) & (F.col("before") < want) & F.col("le").isNotNull(), at))
    return rows.groupBy(*by).agg(F.coalesce(value, F.max("le")).alias("value"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, time: str = "ts") -> DataFrame:
    """Requests, abstentions and measured latency per event-time window and endpoint; works on streams."""
    ms = F.when(F.col("status") != "rejected", duration(F.col("total_ms")))
    return events.groupBy(F.window(time, width, slide or width).alias("w"), "endpoint").agg(
        F.count("*").alias("requests"),
        F.count_if("abstained").alias("abstained"),
        F.sum(ms).alias("total_ms"),
    ).select(F.col("w.start").alias("window_start"), "endpoint", "requests", "abstained", "total_ms")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Sessions of a key: requests at most ``gap`` apart; works on streams."""
    return events.where(F.col(key).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("requests")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests"
    )


def runs_of(rows: DataFrame, key: str, us: str, gap: int) -> DataFrame:
    """Adds ``run``: the number of the run of rows of a ``key`` that follow one another by less than ``gap`` microseconds.

    Rows in one cell of the width of the gap belong together, so cells are counted first and only cells, not rows, meet in
    a window by key; then each row takes the number of its cell.  Null keys are left out.
    """
    cell = F.floor(F.col(us) / F.lit(gap)).alias("_cell")
    cells = rows.where(F.col(key).isNotNull()).groupBy(key, cell).agg(F.min(us).alias("_low"), F.max(us).alias("_high"))
    order = Window.partitionBy(key).orderBy("_cell")
    fresh = F.col("_low") - F.lag("_high").over(order) >= gap
    numbered = cells.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("_cell", F.floor(F.col(us) / F.lit(gap))).join(numbered.select(key, "_cell", "run"), [key, "_cell"]).drop("_cell")


def batch_sessions(events: DataFrame, key: str, gap_seconds: int = 1800, time: str = "ts") -> DataFrame:
    """The sessions of ``sessions`` for a batch: counted in cells of the width of the gap before anything meets by key."""
    gap = gap_seconds * 1_000_000
    us = F.unix_micros(time)
    cells = events.where(F.col(key).isNotNull()).groupBy(key, F.floor(us / F.lit(gap)).alias("_cell")).agg(
        F.min(us).alias("_low"), F.max(us).alias("_high"), F.count("*").alias("_n")
    )
    order = Window.partitionBy(key).orderBy("_cell")
    new = F.coalesce(F.col("_low") - F.lag("_high").over(order) >= gap, F.lit(True)).cast("int")
    numbered = cells.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run").agg(
        F.timestamp_micros(F.min("_low")).alias("session_start"), F.timestamp_micros(F.max("_high") + gap).alias("session_end"), F.sum("_n").alias("requests")
    ).drop("_run")


def abstain_counts(events: DataFrame) -> DataFrame:
    """Requests not answered, by reason."""
    reason = abstain_reason(F.col("status"), F.col("abstained"), F.col("detail"))
    return events.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("requests"))


def recent_requests(events: DataFrame, key: str, seconds: int = LIMIT_WINDOW_SECONDS, cell_seconds: int = 3600) -> DataFrame:
    """``key``, ``us`` and ``in_window``: requests of the key in the last seconds, admitted or not (not the limiter itself).

    Counts by microsecond are cut into cells of an hour; each cell also gets what the last seconds of the one before hold,
    so a window is over a key's hour and not over all it ever did.  Null keys are left out.
    """
    span, cell = seconds * 1_000_000, cell_seconds * 1_000_000
    if span > cell:
        raise ValueError("the window must fit into a cell")
    counts = events.where(F.col(key).isNotNull()).groupBy(key, F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("us") / F.lit(cell))
    carried = F.when(F.col("us") >= (own + 1) * cell - span, F.array(own, own + 1)).otherwise(F.array(own))
    rows = counts.select("*", own.alias("_own"), F.explode(carried).alias("_cell"))
    window = Window.partitionBy(key, "_cell").orderBy("us").rangeBetween(-span, 0)
    return rows.withColumn("in_window", F.sum("n").over(window)).where("_own = _cell").drop("_own", "_cell")


def in_flight(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest number of requests at work at once per day: a running sum of begins and ends within the day."""
    ms = duration(F.col("total_ms"))
    begin = F.unix_micros("ts")
    rows = events.where(ms.isNotNull()).select(
        *by, F.to_date("ts").alias("day"), F.explode(F.array(
            F.struct(begin.alias("t"), F.lit(1).alias("d")),
            F.struct((begin + F.round(ms * 1000).cast("long")).alias("t"), F.lit(-1).alias("d")),
        )).alias("e")
    )
    # begins and ends of a day cancel out, so the sum over all days in order starts every day at zero
    changes = rows.groupBy(*by, "day", F.col("e.t").alias("t"), F.col("e.d").alias("sign")).agg(F.sum("e.d").alias("d"))
    sums = running_sums(changes, by, [F.col("day"), F.col("t"), F.col("sign")], ["d"])
    return sums.groupBy(*by, "day").agg(F.max("d_upto").alias("most"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """``request_id``, ``notes`` (a map): of notes with one name the last by ``seq`` holds, fields of others stay.

    Needs ``request_id``, ``seq``, ``name``, ``value``; null names are left out.
    """
    last = notes.where("name is not null").groupBy("request_id", "name").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("notes"))  # a few names a request


def event_rows(requests: DataFrame) -> DataFrame:
    """One event row a request: scores, margin, stage times, cost and speed, honest miss and the JSON detail.

    ``requests`` has ``id``, ``ts``, ``endpoint``, ``status``, ``http_status``, ``total_ms``, ``query``, ``hits`` (array of
    page_id, score), ``stages`` (map of ms), ``answer_text``, ``abstained``, ``tokens_in``, ``tokens_out``, ``error_type``.
    A rejected request keeps only what is known of it: endpoint, reason, time and the query's identity; all else is null,
    so that it enters no histogram.
    """
    served = F.col("status") != "rejected"
    keep = lambda c: F.when(served, c)
    score = lambda i: F.get("hits", F.lit(i))["score"]
    answer_ms, used = F.col("stages")["answerer"], F.col("tokens_out")
    reason = F.lit(None).cast("string")
    for code, name in REJECT_REASONS.items():
        reason = F.when(F.col("http_status") == code, name).otherwise(reason)
    detail = F.to_json(F.struct(F.col("hits"), F.col("stages")))
    return requests.select(
        "id", "ts", "endpoint", "status", "http_status", "total_ms",
        keep(F.col("stages")["query_encode"]).alias("encode_ms"), keep(answer_ms).alias("answer_ms"),
        keep(score(0)).alias("top_score"), keep(score(0) - score(1)).alias("margin_1_2"), keep(F.col("abstained")).alias("abstained"),
        keep(F.when(F.col("status") == "answered", honest_miss(F.lit("ok"), F.coalesce("abstained", F.lit(False)), F.coalesce("answer_text", F.lit(""))))).alias("honest_miss"),
        F.length("query").alias("query_len"), F.sha2("query", 256).alias("query_sha256"), keep(F.length("answer_text")).alias("answer_len"),
        keep(F.col("tokens_in")).alias("tokens_in"), keep(used).alias("tokens_out"),
        keep(F.when(answer_ms > 0, used / (answer_ms / 1000))).alias("tokens_per_s"),
        keep(token_cost(F.col("tokens_in"), used)).alias("est_cost_usd"),
        F.when(served, F.col("error_type")).otherwise(F.coalesce(reason, F.lit("other"))).alias("error_type"),
        keep(detail).alias("detail"),
    )
