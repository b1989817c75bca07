"""Percentiles of very large numeric columns with a deterministic rank error (problem 5): q-digests.

Values are quantised to a bounded ordered universe of 2**20 leaves: six bits of binary exponent, fourteen of mantissa, so
a leaf is at most 2**-14 of its value wide.  Rows are first counted by leaf (with map-side combination), so a group sends
at most 2**20 numbers however many rows it has.  Compression moves the counts of sparse siblings to their parent in the
dyadic tree while the three together stay at or under ``error * n / 20``; at most 20 such nodes lie above any leaf, so a
rank read from the digest is off by at most ``error * n``.  Digests merge by adding the counts of equal nodes, and the
bound holds for the merged digest too: days combine to a period.

Defined results: null, NaN, infinite and negative values aren't measured; a null group is a group of its own; an empty
table gives an empty digest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexispark.cluster import broadcast_if_small, checkpointed, running_sums

DEPTH = 20
_MANTISSA = 14
_LOW_EXP, _HIGH_EXP = -10, 53
ERROR = 0.001


def leaf_of(value: Column) -> Column:
    """The leaf of a finite value >= 0; values under 2**-10 share leaf 0, those from 2**54 the last."""
    v = F.least(F.greatest(value, F.lit(2.0**_LOW_EXP)), F.lit(2.0 ** (_HIGH_EXP + 1) - 2.0**_HIGH_EXP / 2**_MANTISSA))
    guess = F.floor(F.log2(v)).cast("int")
    # the logarithm may round across a power of two
    exp = (
        F.when(F.pow(F.lit(2.0), guess) > v, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= v, guess + 1).otherwise(guess)
    )
    part = F.floor((v / F.pow(F.lit(2.0), exp) - 1) * 2**_MANTISSA)
    return ((exp - _LOW_EXP) * 2**_MANTISSA + part).cast("int")


def leaf_floor(leaf: Column) -> Column:
    """The smallest value of a leaf (leaf 0 begins at 0)."""
    exp = F.floor(leaf / 2**_MANTISSA) + _LOW_EXP
    low = F.pow(F.lit(2.0), exp) * (1 + F.pmod(leaf, F.lit(2**_MANTISSA)) / 2**_MANTISSA)
    return F.when(leaf <= 0, F.lit(0.0)).otherwise(low)


def measured(value: Column) -> Column:
    """Whether a value is measured."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))


def _compress(nodes: pd.DataFrame, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    level, prefix, n = (nodes[c].to_numpy(np.int64) for c in ("level", "prefix", "n"))
    most = int(n.sum() * error // DEPTH)
    out = []
    here_p, here_n = prefix[level == 0], n[level == 0]
    for depth in range(DEPTH):
        up_p, up_n = prefix[level == depth + 1], n[level == depth + 1]
        parents, where = np.unique(np.concatenate([here_p >> 1, up_p]), return_inverse=True)
        total = np.bincount(where, np.concatenate([here_n, up_n]), len(parents)).astype(np.int64)
        own = np.bincount(where[len(here_p) :], up_n, len(parents)).astype(np.int64)
        moves = total <= most
        stay = ~moves[where[: len(here_p)]]
        out.append((np.full(stay.sum(), depth), here_p[stay], here_n[stay]))
        kept = np.where(moves, total, own)
        here_p, here_n = parents[kept > 0], kept[kept > 0]
    out.append((np.full(len(here_p), DEPTH), here_p, here_n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compressed(nodes: DataFrame, by: Sequence[str], error: float) -> DataFrame:
    keys = [nodes.schema[c] for c in by]
    schema = T.StructType([*keys, *(T.StructField(c, T.LongType()) for c in ("level", "prefix", "n"))])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        level, prefix, n = _compress(frame, error)
        own = {c: [frame[c].iloc[0]] * len(n) for c in by}
        return pd.DataFrame({**own, "level": level, "prefix": prefix, "n": n})

    # a group holds at most one row per node of the tree, whatever the size of the table
    return nodes.groupBy(*by).applyInPandas(run, schema)


def digest(values: DataFrame, by: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """One q-digest per group: ``by``, ``level`` (0 is a leaf), ``prefix``, ``n``."""
    v = F.col(value).cast("double")
    leaves = (
        values.where(measured(v)).groupBy(*by, leaf_of(v).cast("long").alias("prefix")).agg(F.count("*").alias("n"))
    )
    return _compressed(leaves.select(*by, F.lit(0).cast("long").alias("level"), "prefix", "n"), by, error)


def merge_digests(digests: DataFrame, by: Sequence[str], error: float = ERROR) -> DataFrame:
    """Digests of parts (days, partitions) combined to one per group of ``by``."""
    nodes = digests.groupBy(*by, "level", "prefix").agg(F.sum("n").alias("n"))
    return _compressed(nodes, by, error)


def _ends(digests: DataFrame, by: Sequence[str]) -> DataFrame:
    width = F.expr("shiftleft(1L, cast(level as int))")
    low = (F.col("prefix") * width).alias("low")
    spans = digests.select(*by, "level", "n", low, (F.col("prefix") * width + width - 1).alias("high"))
    whole = Window.partitionBy(*by)
    return (
        spans.withColumn("total", F.sum("n").over(whole))
        .withColumn("surely_below", F.sum("n").over(whole.orderBy("high").rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("maybe_below", F.sum("n").over(whole.orderBy("low").rangeBetween(Window.unboundedPreceding, 0)))
    )


def quantiles(digests: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``by``, ``q``, ``n``, ``value_low``, ``value_high``: between the two lies the value of rank ceil(q * n).

    ``estimate`` is the upper end of the node at which the rank is surely reached.
    """
    asked = F.explode(F.array(*[F.lit(float(q)) for q in points])).alias("q")
    ends = _ends(digests, by).select("*", asked)
    rank = F.greatest(F.ceil(F.col("q") * F.col("total") - 1e-9), F.lit(1))
    leaf_high = F.min(F.when(F.col("surely_below") >= rank, F.col("high")))
    leaf_low = F.min(F.when(F.col("maybe_below") >= rank, F.col("low")))
    return (
        ends.groupBy(*by, "q")
        .agg(F.first("total").alias("n"), leaf_low.alias("_lo"), leaf_high.alias("_hi"))
        .select(*by, "q", "n", leaf_floor(F.col("_lo")).alias("value_low"), leaf_floor(F.col("_hi") + 1).alias("value_high"))
        .withColumn("estimate", F.col("value_high"))
    )


def exact_medians(values: DataFrame, by: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """``by`` and ``median`` (mean of the two middle values), exact.

    The digest brackets the median; only values inside the bracket, about ``2 * error`` of the rows, are ordered.
    The columns of ``by`` must not be null.
    """
    v = F.col(value).cast("double")
    rows = values.where(measured(v)).select(*by, v.alias("_v"), leaf_of(v).alias("_leaf"))
    first = F.floor((F.col("total") + 1) / 2)
    second = F.floor(F.col("total") / 2) + 1
    brackets = checkpointed(
        _ends(digest(values, by, value, error), by)
        .groupBy(*by)
        .agg(
            F.first("total").alias("total"),
            F.min(F.when(F.col("maybe_below") >= first, F.col("low"))).alias("lo"),
            F.min(F.when(F.col("surely_below") >= second, F.col("high"))).alias("hi"),
        )
    )
    near = (
        rows.join(broadcast_if_small(brackets), list(by))
        .where("_leaf <= hi")
        .groupBy(*by, F.when(F.col("_leaf") >= F.col("lo"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("k"), F.first("total").alias("total"))
    )
    sums = running_sums(near, by, [F.col("_v").asc_nulls_first()], ["k"]).withColumnRenamed("k_upto", "upto")
    return (
        sums.groupBy(*by)
        .agg(
            F.min(F.when(F.col("_v").isNotNull() & (F.col("upto") >= first), F.col("_v"))).alias("m1"),
            F.min(F.when(F.col("_v").isNotNull() & (F.col("upto") >= second), F.col("_v"))).alias("m2"),
        )
        .select(*by, ((F.col("m1") + F.col("m2")) / 2).alias("median"))
    )


def request_timings(events: DataFrame) -> DataFrame:
    """``id``, ``day``, ``endpoint``, ``pipeline``, ``metric``, ``value`` of every request and measured duration.

    Endpoints in one spelling; an id counts once (the copy received first); rows without id are left out; a null
    endpoint or pipeline becomes ``'(none)'``.
    """
    one = events.where("id is not null").groupBy("id").agg(
        F.min(F.struct("received_at", "ts", "endpoint", "pipeline", "total_ms", "answer_ms")).alias("r")
    )
    flat = one.select(
        "id",
        F.to_date("r.ts").alias("day"),
        F.coalesce(F.regexp_replace(F.lower(F.trim("r.endpoint")), "/+$", ""), F.lit("(none)")).alias("endpoint"),
        F.coalesce("r.pipeline", F.lit("(none)")).alias("pipeline"),
        F.explode(
            F.array(
                F.struct(F.lit("total_ms").alias("metric"), F.col("r.total_ms").alias("value")),
                F.struct(F.lit("answer_ms").alias("metric"), F.col("r.answer_ms").alias("value")),
            )
        ).alias("m"),
    )
    return flat.select("id", "day", "endpoint", "pipeline", "m.metric", "m.value").where(measured(F.col("value")))


def slow_requests(timings: DataFrame, factor: float = 5.0) -> DataFrame:
    """``id`` and ``metric`` of values above ``factor`` times the median of their endpoint and pipeline."""
    by = ["endpoint", "pipeline", "metric"]
    medians = checkpointed(exact_medians(timings, by, "value"))
    return timings.join(broadcast_if_small(medians), by).where(F.col("value") > factor * F.col("median")).select("id", "metric")
