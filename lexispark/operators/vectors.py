"""Vector operators on array columns: dot products, quantisation, sign bits, MaxSim in three representations.

Token tables have ``page_id``, ``token_pos``, ``vec``; query tables ``query_id``, ``token_pos``, ``vec``.  Null vectors
are left out.  Equal scores go by page id, for late interaction in descending order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.cluster import checkpointed

# Saturation of int8 codes, smallest scale, candidates of the first stage.
INT8_MAX, MIN_SCALE = 127, 1e-8
STAGE1 = 200
#: Query vectors are handed to the scan in blocks of this many, so that a block has a bound whatever the query set.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sign_bits(vec: Column) -> Column:
    """Up to 64 signs as the bits of a long, the first element in the highest place; a longer vector raises an error."""
    bits = F.aggregate(vec, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("long")))
    return F.when(F.size(vec) > 64, F.raise_error(F.lit("more than 64 elements: use sign_words")).cast("long")).otherwise(bits)


def sign_words(vec: Column) -> Column:
    """Signs of a vector of any width as longs of 64 bits each; the last one holds what is left."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(vec), F.lit(1)), F.lit(64))
    return F.when(F.size(vec) > 0, F.transform(starts, lambda at: sign_bits(F.slice(vec, at, 64))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Bits in which two arrays of longs differ; null if they are not of one length."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both)


def int8_scale(vec: Column) -> Column:
    """Scale of int8 codes: the largest magnitude over 127, at least 1e-8."""
    return F.greatest(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))) / INT8_MAX, F.lit(MIN_SCALE))


def int8_codes(vec: Column, scale: Column) -> Column:
    """Codes rounded half to even and clipped."""
    code = lambda x: F.rint(x.cast("double") / scale)
    return F.transform(vec, lambda x: F.greatest(F.least(code(x), F.lit(float(INT8_MAX))), F.lit(-float(INT8_MAX))).cast("tinyint"))


def mean_vectors(tokens: DataFrame) -> DataFrame:
    """``page_id``, ``vec``: the mean vector of a page, each element rounded to twelve places so that the order of the sum
    doesn't matter; a page without vectors has none."""
    cells = tokens.where("vec is not null").select("page_id", F.posexplode("vec").alias("i", "x"))
    means = cells.groupBy("page_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 12).alias("m"))
    rows = means.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))  # as many as a vector is wide
    return rows.select("page_id", F.transform("v", lambda s: s["m"]).alias("vec"))


def mean_sign_vectors(tokens: DataFrame) -> DataFrame:
    """``page_id``, ``bits``: signs of the mean vector of a page."""
    return mean_vectors(tokens).select("page_id", sign_bits(F.col("vec")).alias("bits"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _codes(m: np.ndarray) -> np.ndarray:
    """What int8 codes give back: rounded half to even, clipped, scaled again."""
    scale = np.maximum(np.abs(m).max(axis=1, keepdims=True) / INT8_MAX, MIN_SCALE)
    return np.clip(np.rint(m / scale), -INT8_MAX, INT8_MAX) * scale


def _signs(m: np.ndarray) -> np.ndarray:
    return np.where(m > 0, 1.0, -1.0)


#: What is done to query vectors and to page vectors before their products are taken.
REPRESENTATIONS = {"float": (lambda m: m, lambda m: m), "cosine": (_unit, _unit), "int8": (lambda m: m, _codes), "binary": (_signs, _signs)}


def _blocks(queries: DataFrame, score) -> DataFrame:
    """The union of ``score(block)`` over blocks of the query set.

    A stated query set meets all pages block by block: never more than a block of ``QUERY_BLOCK`` vectors is on the driver
    or in a task, and with several blocks each one's result is written before the next is taken.
    """
    asked = queries.where("vec is not null")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if blocks <= 1:
        return score(asked.toPandas())
    asked = checkpointed(asked.repartitionByRange(blocks, "query_id").withColumn("_block", F.spark_partition_id()))
    parts = []
    for block in range(blocks):
        rows = asked.where(F.col("_block") == block).drop("_block").toPandas()
        parts += [checkpointed(score(rows.iloc[at : at + QUERY_BLOCK])) for at in range(0, len(rows), QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, parts)


def nearest(pages: DataFrame, queries: DataFrame, limit: int, kind: str = "cosine") -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``rank``: the ``limit`` pages with the largest product to each query vector.

    Each Arrow batch is one matrix product and keeps the ``limit`` best pages of a query, so what is shuffled grows with
    batches, not with pairs.
    """
    of_query, of_page = REPRESENTATIONS[kind]
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (pages, "page_id"))}
    schema = f"query_id {types['query_id']}, page_id {types['page_id']}, score double"

    def score(block: pd.DataFrame) -> DataFrame:
        ids, q = block["query_id"].to_numpy(), of_query(_matrix(block["vec"])) if len(block) else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                names = batch["page_id"].to_numpy()
                order = np.argsort(names, kind="stable")
                sims = np.round(q @ of_page(_matrix(batch["vec"]))[order].T, 9)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :limit]
                best = np.take_along_axis(sims, top, 1)
                yield pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "page_id": names[order][top.ravel()], "score": best.ravel()})

        return pages.where("vec is not null").select("page_id", "vec").mapInPandas(run, schema)

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    return _blocks(queries.select("query_id", "vec"), score).withColumn("rank", place).where(F.col("rank") <= limit)


def dense_top(pages: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``rank``: best cosine neighbours of each query vector."""
    return nearest(pages, queries, limit, "cosine")


def maxsim(tokens: DataFrame, queries: DataFrame, kind: str = "float") -> DataFrame:
    """``query_id``, ``page_id``, ``total``, ``n_query``: sum over query tokens of the best page token, by ``kind`` of
    representation (float, int8 or binary).

    A batch of page tokens meets a block of query tokens in one matrix product; of each page in the batch only the best
    token for each query token leaves it.
    """
    of_query, of_page = REPRESENTATIONS[kind]
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (tokens, "page_id"))}
    schema = f"query_id {types['query_id']}, i long, page_id {types['page_id']}, s double"

    def score(block: pd.DataFrame) -> DataFrame:
        ids, at = block["query_id"].to_numpy(), block["token_pos"].to_numpy()
        q = of_query(_matrix(block["vec"])) if len(block) else None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                names, first = np.unique(np.sort(batch["page_id"].to_numpy()), return_index=True)
                order = np.argsort(batch["page_id"].to_numpy(), kind="stable")
                best = np.maximum.reduceat(q @ of_page(_matrix(batch["vec"]))[order].T, first, axis=1)
                yield pd.DataFrame(
                    {"query_id": np.repeat(ids, len(names)), "i": np.repeat(at, len(names)).astype("int64"), "page_id": np.tile(names, len(ids)), "s": best.ravel()}
                )

        return tokens.where("vec is not null and page_id is not null").select("page_id", "vec").mapInPandas(run, schema)

    return (
        _blocks(queries.select("query_id", "token_pos", "vec"), score)
        .groupBy("query_id", "page_id", "i")
        .agg(F.max("s").alias("s"))
        .groupBy("query_id", "page_id")
        .agg(F.sum("s").alias("total"), F.count("*").alias("n_query"))
    )


def two_stage(tokens: DataFrame, queries: DataFrame, limit: int, first: int = STAGE1) -> DataFrame:
    """``query_id``, ``page_id``, ``score``, ``rank``: the ``first`` nearest pages of each query by Hamming distance to
    the signs of their mean vectors, of those the ``limit`` best by exact MaxSim on sign bits.

    Queries hold one vector each; of vectors up to 64 wide.  A page beyond the first stage is lost however close its best
    token is.
    """
    from lexispark.operators.lexical import rank_pages

    stage1 = nearest(mean_vectors(tokens), queries, first, "binary").select("query_id", "page_id")
    asked = queries.select("query_id", sign_bits(F.col("vec")).alias("_q"), F.size("vec").alias("_w"))
    own = tokens.where("vec is not null").select("page_id", sign_bits(F.col("vec")).alias("_t")).distinct()  # one product each
    pairs = stage1.join(asked, "query_id").join(own, "page_id")
    best = pairs.groupBy("query_id", "page_id").agg(F.max(F.col("_w") - 2 * hamming(F.col("_q"), F.col("_t"))).cast("double").alias("score"))
    return rank_pages(best, limit)


def late_ranking(scores: DataFrame, score: str = "total") -> DataFrame:
    """Late channels rank equal scores by page in descending order."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), F.desc("page_id")))
    return scores.withColumn("rank", place)


def top_and_margin(ranked: DataFrame, score: str = "total") -> DataFrame:
    """Best score of a query, its margin to the next page (0 for one page), and both per query token."""
    first = F.max(F.when(F.col("rank") == 1, F.col(score)))
    second = F.max(F.when(F.col("rank") == 2, F.col(score)))
    n = F.max("n_query")
    margin = F.when(second.isNull(), F.lit(0.0)).otherwise(first - second)
    return ranked.where("rank <= 2").groupBy("query_id").agg(
        first.alias("top1"), margin.alias("margin"), (first / n).alias("mean_top1"), (margin / n).alias("mean_margin")
    )


def hash_encoder(texts: DataFrame, text_id: str, text: str, tokens: int = 4, width: int = 64) -> DataFrame:
    """Deterministic stand-in for a model: normal vectors seeded by the first 8 bytes of SHA-256 of the text.

    The slot for real encoders has the same shape: a function of batches of texts to token vectors.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, t in zip(batch[text_id], batch["_text"], strict=True):
                seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big")
                vecs = np.random.default_rng(seed).standard_normal((tokens, width)).astype(np.float32)
                rows.extend((key, i, v) for i, v in enumerate(vecs))
            yield pd.DataFrame(rows, columns=[text_id, "token_pos", "vec"])

    kind = texts.schema[text_id].dataType.simpleString()
    return texts.select(text_id, F.col(text).alias("_text")).mapInPandas(run, f"{text_id} {kind}, token_pos int, vec array<float>")
