"""Rank lists: interleaved union, candidate pools, first-seen de-duplication, reranking, reciprocal rank fusion.

A list has ``query_id``, ``page_id``, ``rank`` (1-based, no repeats).  Empty lists give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Pool limit of each source, constant of reciprocal rank fusion.
POOL_LIMIT = 50
RRF_K = 60


def as_list(rows: DataFrame, order: Sequence, limit: int | None = None) -> DataFrame:
    """A rank list of distinct pages from scored rows; ``order`` sorts the rows of a query."""
    first = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "page_id"))
    out = rows.withColumn("_n", first).where("_n = 1").withColumn("rank", place).select("query_id", "page_id", "rank")
    return out if limit is None else out.where(F.col("rank") <= limit)


def first_seen(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each page of a query at its first place in ``order``, ranked anew."""
    # both windows are partitioned by a prefix of the same keys, so one shuffle by query serves both
    seen = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy(*order))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kept = rows.repartition("query_id").withColumn("_n", seen).where("_n = 1")
    return kept.withColumn("rank", place).select("query_id", "page_id", "rank")


def interleave(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """a1 b1 a2 b2 ... up to the shorter list, then the rest of the first, then of the second; repeats dropped."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1)))
    per_query = Window.partitionBy("query_id")
    n_a = F.coalesce(F.max(F.when(F.col("_src") == 0, F.col("rank"))).over(per_query), F.lit(0))
    n_b = F.coalesce(F.max(F.when(F.col("_src") == 1, F.col("rank"))).over(per_query), F.lit(0))
    rows = both.repartition("query_id").withColumn("_both", F.least(n_a, n_b))
    paired = F.col("rank") <= F.col("_both")
    rows = rows.select(
        "query_id",
        "page_id",
        F.when(paired, 0).otherwise(1).alias("_k1"),
        F.when(paired, F.col("rank")).otherwise(F.col("_src")).alias("_k2"),
        F.when(paired, F.col("_src")).otherwise(F.col("rank")).alias("_k3"),
    )
    return first_seen(rows, ["_k1", "_k2", "_k3"])


def interleave_all(base: DataFrame, channels: Sequence[DataFrame]) -> DataFrame:
    """Channels folded into ``base`` one after the other; the first page stays first."""
    return reduce(interleave, channels, base)


def candidate_pool(sources: Sequence[DataFrame], limit: int = POOL_LIMIT) -> DataFrame:
    """The first ``limit`` pages of each source one after the other, without repeats."""
    parts = [s.where(F.col("rank") <= limit).withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    return first_seen(reduce(DataFrame.unionByName, parts), ["_src", "rank"])


def reciprocal_rank_fusion(sources: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; an ablation, not part of the search."""
    both = reduce(DataFrame.unionByName, sources)
    scores = both.groupBy("query_id", "page_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "page_id"))
    return scores.withColumn("rank", place)


def rerank(pool: DataFrame, scores: DataFrame, pin_first: bool) -> DataFrame:
    """Order a pool by ``score``; with ``pin_first`` the pool's first page stays first.  Unscored pages come last."""
    rows = pool.join(scores.select("query_id", "page_id", "score"), ["query_id", "page_id"], "left")
    pinned = F.when(F.lit(pin_first) & (F.col("rank") == 1), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(pinned, F.desc_nulls_last("score"), "rank"))
    return rows.withColumn("new_rank", place)


def pages_of_chunks(chunk_pages: DataFrame) -> DataFrame:
    """``chunk_id``, ``pages``: the distinct pages that a chunk touches; chunks without any are left out."""
    pairs = chunk_pages.select("chunk_id", F.explode("page_ids").alias("page_id")).where("chunk_id is not null and page_id is not null")
    return pairs.groupBy("chunk_id").agg(F.collect_set("page_id").alias("pages"))  # as many as a chunk has


def chunks_to_pages(chunk_scores: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """Page scores as the best of the chunks that touch the page; ``n_chunks`` says how many of them had a score."""
    pairs = chunk_pages.select("chunk_id", F.explode("page_ids").alias("page_id")).where("page_id is not null").distinct()
    return chunk_scores.join(pairs, "chunk_id").groupBy("query_id", "page_id").agg(F.max("score").alias("score"), F.count("*").alias("n_chunks"))


def pages_or_own(chunk_scores: DataFrame, chunk_pages: DataFrame, own: DataFrame) -> DataFrame:
    """Scores of the pages in ``own`` (query_id, page_id, score): the best of the chunks on a page, its own without any."""
    best = chunks_to_pages(chunk_scores, chunk_pages).select("query_id", "page_id", F.col("score").alias("_best"), "n_chunks")
    rows = own.join(best, ["query_id", "page_id"], "left")
    return rows.select("query_id", "page_id", F.coalesce("_best", "score").alias("score"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
