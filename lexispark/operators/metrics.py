"""Retrieval metrics over rank lists and gold pages.

``gold`` has ``query_id``, ``page_id`` (distinct); ``ranked`` has ``query_id``, ``page_id``, ``rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cut-offs of the recall table.
CUTS = (1, 5, 10, 20, 50, 200)


def gold_hits(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every gold page with the rank at which it was found, null if it was not."""
    return gold.join(ranked.select("query_id", "page_id", "rank"), ["query_id", "page_id"], "left")


def per_query(hits: DataFrame, cuts: Sequence[int] = CUTS, ndcg_at: int = 5) -> DataFrame:
    """Recall at each cut (found share of the gold pages), reciprocal rank and nDCG of every query."""
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(ndcg_at))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("n_gold"),
        F.min("rank").alias("best"),
        *[F.sum((F.col("rank") <= k).cast("int")).alias(f"_hit{k}") for k in cuts],
        F.sum(F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
    )
    return found.select(
        "query_id",
        "n_gold",
        "best",
        *[(F.coalesce(f"_hit{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_at_{k}") for k in cuts],
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"),
        (F.col("_dcg") / ideal).alias(f"ndcg_at_{ndcg_at}"),
    )


def metric_blocks(scores: DataFrame, slices: DataFrame, docs: DataFrame, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Means over all queries, per slice and per gold document in one pass.

    A query with several gold documents counts once in each.  ``slices`` has ``query_id``, ``slice``; ``docs`` has
    ``query_id``, ``doc_id``.
    """
    scopes = F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("").alias("value")),
        F.struct(F.lit("slice").alias("scope"), F.coalesce("slice", F.lit("")).alias("value")),
    )
    plain = scores.join(slices, "query_id", "left").select("*", F.explode(scopes).alias("s")).drop("slice")
    per_doc = scores.join(docs.distinct(), "query_id").select(
        *scores.columns, F.struct(F.lit("doc").alias("scope"), F.col("doc_id").alias("value")).alias("s")
    )
    names = [f"recall_at_{k}" for k in cuts] + ["mrr", "ndcg_at_5"]
    return (
        plain.unionByName(per_doc)
        .groupBy(F.col("s.scope").alias("scope"), F.col("s.value").alias("value"))
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    )


def hit_rates(scores: DataFrame, cuts: Sequence[int], n_pages: int) -> DataFrame:
    """Share of queries with any gold page within each cut; a query that found none has rank ``n_pages`` + 1."""
    rank = F.coalesce("best", F.lit(n_pages + 1))
    return scores.agg(
        F.count("*").alias("n"),
        *[F.avg((rank <= k).cast("double")).alias(f"hit_at_{k}") for k in cuts],
        F.avg(1 / rank).alias("mrr_all"),
    )


def compare_arms(base: DataFrame, other: DataFrame, cut: int = 5) -> DataFrame:
    """One row: gains and losses within the cut, and the verdict on the other arm.

    Kept from two more hits on, kept as single with one, else discarded; any loss in mean reciprocal rank discards.
    """
    best = lambda df, name: df.select("query_id", F.col("best").alias(f"{name}_best"), F.col("mrr").alias(f"{name}_mrr"))
    rows = best(base, "a").join(best(other, "b"), "query_id", "full")
    a, b = F.coalesce(F.col("a_best") <= cut, F.lit(False)), F.coalesce(F.col("b_best") <= cut, F.lit(False))
    out = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a_mrr").isNull() | F.col("b_mrr").isNull()).alias("unmatched"),
        F.count_if(b & ~a).alias("gained"),
        F.count_if(a & ~b).alias("lost"),
        F.avg("a_mrr").alias("base_mrr"),
        F.avg("b_mrr").alias("arm_mrr"),
    )
    delta = F.col("gained") - F.col("lost")
    worse = F.col("arm_mrr") < F.col("base_mrr") - 1e-9
    return out.withColumn(
        "verdict", F.when(worse | (delta < 1), "DISCARDED").when(delta >= 2, "KEPT").otherwise("KEPT(single)")
    )


def bootstrap_interval(values: DataFrame, value: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``mean``, ``low``, ``high``: percentile bootstrap of a mean.

    Each row draws how often it enters each resample (Poisson with mean 1, from a hash of row, resample and seed), so the
    table is never copied or collected; sums are combined before the shuffle.
    """
    import numpy as np
    import pandas as pd

    def sums(batches):
        total, weight = np.zeros(resamples), np.zeros(resamples)
        plain, n = 0.0, 0
        for batch in batches:
            for key, v in zip(batch["_key"], batch["_v"], strict=True):
                draws = np.random.default_rng([seed, key & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, resamples)
                total += draws * v
                weight += draws
                plain, n = plain + v, n + 1
        yield pd.DataFrame({"b": np.arange(resamples), "t": total, "w": weight, "p": plain, "n": n})

    rows = values.select(F.xxhash64(*values.columns).alias("_key"), F.col(value).cast("double").alias("_v")).dropna()
    parts = rows.mapInPandas(sums, "b int, t double, w double, p double, n long")
    means = parts.groupBy("b").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"), (F.sum("p") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    return means.agg(
        F.max("mean").alias("mean"),
        F.percentile("m", F.lit(alpha / 2)).alias("low"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("high"),
    )
