"""Problems 5 and 6: error bounds, merging, brute force and edge cases."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexispark.cluster import spread_lookup
from lexispark.llm import quantiles, topn


def _rank_range(values, x_low, x_high):
    return sum(v < x_low for v in values) + 1, sum(v <= x_high for v in values)


def test_quantiles_keep_their_bound_and_merge(spark):
    rng = random.Random(9)
    groups = {"a": [rng.lognormvariate(3, 2) for _ in range(4000)], "b": [float(rng.randrange(5)) for _ in range(1000)], "c": [7.5], None: [1.0, 2.0]}
    rows = [(g, rng.randrange(3), v) for g, vs in groups.items() for v in vs] + [("a", 0, float("nan")), ("a", 0, -1.0), ("b", 1, None), ("a", 0, float("inf"))]
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("n", F.lit(0))
    error = 0.02
    whole = quantiles.quantiles(quantiles.digest(df, ["g"], "v", error), ["g"], [0.01, 0.5, 0.99])
    days = quantiles.merge_digests(quantiles.digest(df, ["g", "day"], "v", error), ["g"], error)
    for out in (whole, quantiles.quantiles(days, ["g"], [0.01, 0.5, 0.99])):
        for r in out.collect():
            values = groups[r["g"]]
            assert r["n"] == len(values)
            first, last = _rank_range(values, r["value_low"], r["value_high"])
            rank = max(1, -(-int(r["q"] * len(values) * 1e6) // 10**6))
            assert first <= rank <= last  # the value of the rank lies between the two
            # and the upper end is not farther than the stated rank error
            top = max(v for v in values if v < r["value_high"])
            assert sum(v < top for v in values) <= rank + error * len(values)
    assert quantiles.quantiles(quantiles.digest(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_a_digest_is_smaller_than_its_data(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), (F.rand(3) * 1e6).alias("v"))
    digest = quantiles.digest(df, ["g"], "v", 0.05)
    assert digest.count() < 3 * quantiles.DEPTH / 0.05
    assert digest.agg(F.sum("n")).first()[0] == 60_000


def test_exact_medians(spark):
    rng = random.Random(10)
    groups = {f"g{k}": [round(rng.lognormvariate(2, 1), 3) for _ in range(k * 37 + 1)] for k in range(8)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["median"] for r in quantiles.exact_medians(df, ["g"], "v", 0.05).collect()}
    assert got == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items()}


EVENTS = "id long, ts timestamp, received_at timestamp, endpoint string, pipeline string, total_ms double, answer_ms double"


def test_slow_requests(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t, t, "/Ask/" if i % 2 else "/ask", None, 10.0, None) for i in range(9)] + [(9, t, t, "/ask", None, 51.0, -5.0), (10, t, t, "/ask", "h", 51.0, float("nan"))]
    rows += [(9, t, t + dt.timedelta(1), "/ask", None, 1.0, None), (None, t, t, "/ask", None, 9999.0, None), (11, t, None, None, None, 5.0, 1.0)]
    timings = quantiles.request_timings(spark.createDataFrame(rows, EVENTS).withColumn("metric", F.lit("clash")))
    assert {tuple(r) for r in quantiles.slow_requests(timings).collect()} == {(9, "total_ms")}
    empty = quantiles.request_timings(spark.createDataFrame([], EVENTS))
    assert quantiles.slow_requests(empty).count() == 0


def _top(spark, rows, n, **how):
    df = spark.createDataFrame(rows, "q string, p string, s double").withColumn("grp", F.lit(1)).withColumn("item", F.lit(2)).repartition(3)
    return {(r["q"], r["hit_rank"], r["p"]) for r in topn.top_n(df, "q", "p", "s", n, **how).collect()}


def _slow_top(rows, n):
    best = {}
    for q, p, s in rows:
        if None not in (q, p, s) and s == s:
            best.setdefault(q, {})[p] = max(s, best.get(q, {}).get(p, float("-inf")))
    return {(q, i + 1, p) for q, ps in best.items() for i, (p, _) in enumerate(sorted(ps.items(), key=lambda x: (-x[1], x[0]))[:n])}


def test_top_n_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(f"q{rng.randrange(4) if rng.random() < 0.6 else 0}", f"p{rng.randrange(30)}", rng.choice([1.0, 2.0, 2.5, None, float("nan"), -3.0, float("inf")])) for _ in range(1500)]
    rows += [(None, "p", 1.0), ("q", None, 1.0), ("lonely", "ü", 0.0)]
    for n in (1, 5, 100):
        assert _top(spark, rows, n) == _slow_top(rows, n)
        assert _top(spark, rows, n, broadcast_rows=0) == _slow_top(rows, n)
    assert _top(spark, [], 5) == _top(spark, [], 5, broadcast_rows=0) == set()
    same = [("q", f"p{i:03d}", 1.0) for i in range(300)]
    assert _top(spark, same, 5) == _top(spark, same, 5, broadcast_rows=0) == _slow_top(same, 5)


def test_many_groups_and_a_hot_one_beyond_the_broadcast(spark):
    rows = spark.range(60_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.pmod(F.xxhash64("id"), F.lit(5000)))).alias("q"),
        F.concat(F.lit("p"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000))).alias("p"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 7).alias("s"),
    )
    want = {tuple(r) for r in topn.top_n(rows, "q", "p", "s", 5).collect()}
    assert {tuple(r) for r in topn.top_n(rows, "q", "p", "s", 5, broadcast_rows=0).collect()} == want
    assert {(q, r, p) for q, r, p, _ in want} == _slow_top([tuple(r) for r in rows.collect()], 5)


def test_a_hot_key_is_spread_in_the_join(spark):
    big = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    sizes = big.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_lookup(big, small, ["k"], ["id"], sizes, "left")
        parts = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
        assert sum(parts) == 40_000 and out.where("v is null").count() == 0 and max(parts) < 16_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
