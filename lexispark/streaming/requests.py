"""Structured Streaming over request logs: windowed counts, sessions, de-duplication and the sliding-window limiter.

The functions take a streaming frame and give one, so sources and sinks are the caller's.  Late rows beyond the
watermark are dropped by the stateful operators; a replay with a watermark longer than the log equals the batch result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lexispark.operators.events import endpoint_form, window_counts

WATERMARK = "40 days"


def read_requests(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A stream of the parquet files that ``path`` (a folder or a pattern) names, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Rows whose id was not seen within the watermark, with one spelling of the endpoint."""
    return (
        stream.where("id is not null")
        .withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["id"])
        .withColumn("endpoint", endpoint_form(F.col("endpoint")))
    )


def windowed(stream: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Requests, abstentions and latency per tumbling window and endpoint."""
    return window_counts(deduplicated(stream, watermark), width)


def limiter(limit: int, seconds: int):
    """State function of the sliding-window limiter: a request is admitted if fewer than ``limit`` admitted ones lie in
    the last ``seconds``; rejected requests take no slot; otherwise the wait until the oldest slot frees is given."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing was admitted within the window any more: as if the client had never been seen
            state.remove()
            return
        admitted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for row in rows.itertuples(index=False):
            now = row.ts.timestamp()
            while admitted and admitted[0] <= now - seconds:
                admitted.popleft()
            ok = len(admitted) < limit
            out.append((key[0], row.id, ok, 0.0 if ok else max(1.0, seconds - (now - admitted[0]))))
            if ok:
                admitted.append(now)
        state.update((list(admitted),))
        last = max([*admitted, 0.0]) * 1000
        state.setTimeoutTimestamp(int(max(last, state.getCurrentWatermarkMs()) + seconds * 1000 + 1))
        yield pd.DataFrame(out, columns=["client", "id", "admitted", "retry_after"])

    return run


def limited(stream: DataFrame, client: str, limit: int = 2, seconds: int = 60) -> DataFrame:
    """``client``, ``id``, ``admitted``, ``retry_after`` of every request; state is one short deque per client.

    ``stream`` has a watermark on ``ts``: a client's state ends when the watermark has left its last admitted request behind.
    """
    return (
        stream.select(F.col(client).alias("client"), "id", "ts").where("client is not null and id is not null and ts is not null")
        .groupBy("client")
        .applyInPandasWithState(
            limiter(limit, seconds),
            "client string, id long, admitted boolean, retry_after double",
            "slots array<double>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; append to parquet files (exactly once) or write the complete result."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
