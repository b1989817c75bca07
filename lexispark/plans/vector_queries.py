"""Vector channel on the embedding table: a label is a page, its rows are tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import vectors
from lexispark.plans.registry import query
from lexispark.sources.tables import table

_VALID = "e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL)"
_BITS = "CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (CASE WHEN i = 1 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) END) ELSE 0 END)) AS BIGINT)"
_Q = "q AS (SELECT vec_id AS query_id, embedding AS q FROM e WHERE vec_id % 20 = 0)"
_DOT = "list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[]))"
_COS = f"round({_DOT} / (sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 9)"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").where("embedding is not null")


def _tokens(spark, folder):
    return _vectors(spark, folder).select(F.col("label").alias("page_id"), F.col("vec_id").alias("token_pos"), F.col("embedding").alias("vec"))


def _queries(spark, folder):
    rows = _vectors(spark, folder).where("vec_id % 20 = 0")
    return rows.select(F.col("label").alias("query_id"), F.col("vec_id").alias("token_pos"), F.col("embedding").alias("vec"))


@query(f"WITH {_VALID} SELECT vec_id, {_BITS} AS bits FROM e")
def sign_pack(spark, folder):
    """Sign bits of every vector."""
    return _vectors(spark, folder).select("vec_id", vectors.sign_bits(F.col("embedding")).alias("bits"))


@query(f"""WITH {_VALID}, b AS (SELECT vec_id, {_BITS} AS bits FROM e), d AS (
    SELECT q.vec_id AS query_id, b.vec_id AS page_id, bit_count(xor(q.bits, b.bits)) AS distance FROM b JOIN b q ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, page_id) AS rank FROM d)
SELECT query_id, page_id, distance, rank FROM r WHERE rank <= 10""")
def hamming_top10(spark, folder):
    """Ten nearest vectors by Hamming distance of the sign bits."""
    rows = _vectors(spark, folder)
    pages = rows.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    near = vectors.nearest(pages, asked, 10, "binary")  # of 64 signs, each that differs takes 2 from the product
    return near.select("query_id", "page_id", ((64 - F.col("score")) / 2).cast("int").alias("distance"), "rank")


_SCALE = "greatest(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127, 1e-8)"


@query(f"""WITH {_VALID}, c AS (SELECT vec_id, {_SCALE} AS scale, embedding FROM e),
k AS (SELECT vec_id, scale, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(least(round_even(x / scale, 0), 127), -127)) AS codes FROM c)
SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(codes) AS BIGINT) AS code_sum,
CAST(list_max(codes) AS BIGINT) AS code_max, CAST(list_min(codes) AS BIGINT) AS code_min FROM k""")
def quantize_int8(spark, folder):
    """Scale and code statistics of int8 quantisation."""
    rows = _vectors(spark, folder).withColumn("scale", vectors.int8_scale(F.col("embedding")))
    rows = rows.withColumn("codes", vectors.int8_codes(F.col("embedding"), F.col("scale")))
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        "vec_id", F.round("scale", 9).alias("scale"), total.alias("code_sum"),
        F.array_max("codes").cast("long").alias("code_max"), F.array_min("codes").cast("long").alias("code_min"),
    )


@query(f"""WITH {_VALID}, {_Q}, s AS (SELECT query_id, vec_id AS page_id, {_COS} AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s)
SELECT query_id, page_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_top10(spark, folder):
    """Ten nearest vectors by cosine."""
    rows = _vectors(spark, folder)
    pages = rows.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vec"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.dense_top(pages, asked, 10).select("query_id", "page_id", "rank", F.round("score", 6).alias("score"))


_QT = "q AS (SELECT label AS query_id, vec_id AS q_pos, embedding AS q FROM e WHERE vec_id % 20 = 0)"


def _maxsim_sql(value: str, q: str = "q", extra: str = "") -> str:
    return f"""WITH {_VALID}{extra}, {_QT if q == 'q' else q}, best AS (SELECT query_id, label AS page_id, q_pos, max({value}) AS s FROM q, e GROUP BY ALL),
t AS (SELECT query_id, page_id, sum(s) AS total, count(*) AS n_query FROM best GROUP BY ALL)"""


@query(f"{_maxsim_sql(_DOT)} SELECT query_id, page_id, round(total / n_query, 6) AS score FROM t")
def maxsim_float(spark, folder):
    """MaxSim of every query and page: mean over query tokens of the best dot product."""
    out = vectors.maxsim(_tokens(spark, folder), _queries(spark, folder))
    return out.select("query_id", "page_id", F.round(F.col("total") / F.col("n_query"), 6).alias("score"))


_DEQ = f"list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(least(round_even(x / {_SCALE}, 0), 127), -127) * {_SCALE})"


@query(f"""WITH e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_SCALE} AS scale, embedding FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT vec_id, label, list_transform(v, lambda x: greatest(least(round_even(x / scale, 0), 127), -127) * scale) AS d, embedding FROM e0),
q AS (SELECT label AS query_id, vec_id AS q_pos, CAST(embedding AS DOUBLE[]) AS q FROM e WHERE vec_id % 20 = 0),
best AS (SELECT query_id, label AS page_id, q_pos, max(list_dot_product(q, d)) AS s FROM q, e GROUP BY ALL)
SELECT query_id, page_id, round(sum(s) / count(*), 6) AS score FROM best GROUP BY ALL""")
def maxsim_int8(spark, folder):
    """MaxSim against int8 codes."""
    out = vectors.maxsim(_tokens(spark, folder), _queries(spark, folder), "int8")
    return out.select("query_id", "page_id", F.round(F.col("total") / F.col("n_query"), 6).alias("score"))


@query(f"""WITH {_VALID}, b AS (SELECT vec_id, label, {_BITS} AS bits FROM e),
best AS (SELECT q.label AS query_id, b.label AS page_id, q.vec_id AS q_pos, max(64 - 2 * bit_count(xor(q.bits, b.bits))) AS s FROM b JOIN b q ON q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, page_id, round(sum(s) / count(*) / 64, 6) AS score FROM best GROUP BY ALL""")
def maxsim_binary(spark, folder):
    """MaxSim on sign bits, between -1 and 1."""
    out = vectors.maxsim(_tokens(spark, folder), _queries(spark, folder), "binary")
    return out.select("query_id", "page_id", F.round(F.col("total") / F.col("n_query") / 64, 6).alias("score"))


@query(f"""{_maxsim_sql(_DOT)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, page_id DESC) AS rank FROM t),
m AS (SELECT query_id, max(CASE WHEN rank = 1 THEN total END) AS a, max(CASE WHEN rank = 2 THEN total END) AS b, max(n_query) AS n FROM r WHERE rank <= 2 GROUP BY 1)
SELECT query_id, round(a, 6) AS top1, round(CASE WHEN b IS NULL THEN 0 ELSE a - b END, 6) AS margin, round(a / n, 6) AS mean_top1,
round(CASE WHEN b IS NULL THEN 0 ELSE a - b END / n, 6) AS mean_margin FROM m""")
def late_top_and_margin(spark, folder):
    """Best late-interaction score of each query and its margin."""
    ranked = vectors.late_ranking(vectors.maxsim(_tokens(spark, folder), _queries(spark, folder)))
    out = vectors.top_and_margin(ranked)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("top1", "margin", "mean_top1", "mean_margin")])


_MEANS = """cells AS (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 12) AS m FROM e, range(1, 65) r(i) GROUP BY ALL),
pages AS (SELECT label, CAST(sum(CASE WHEN m > 0 THEN (CASE WHEN i = 1 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) END) ELSE 0 END) AS BIGINT) AS bits FROM cells GROUP BY label)"""


@query(f"WITH {_VALID}, {_MEANS} SELECT label AS page_id, bits FROM pages")
def page_mean_signs(spark, folder):
    """Signs of the mean vector of every page."""
    return vectors.mean_sign_vectors(_tokens(spark, folder))


@query(f"""WITH {_VALID}, {_MEANS}, b AS (SELECT label, {_BITS} AS bits FROM e), qb AS (SELECT vec_id AS query_id, {_BITS} AS bits FROM e WHERE vec_id % 20 = 0),
s1 AS (SELECT query_id, label, qb.bits, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(qb.bits, pages.bits)), label) AS r1 FROM qb, pages),
s2 AS (SELECT query_id, s1.label AS page_id, max(64 - 2 * bit_count(xor(s1.bits, b.bits))) AS score FROM s1 JOIN b ON b.label = s1.label WHERE r1 <= {vectors.STAGE1} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM s2)
SELECT query_id, page_id, rank, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 3""")
def two_stage_search(spark, folder):
    """Two hundred pages by Hamming distance to the mean signs, then exact MaxSim on sign bits; three best pages."""
    asked = _vectors(spark, folder).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.two_stage(_tokens(spark, folder), asked, 3).select("query_id", "page_id", "rank", "score")


@query(f"""WITH {_VALID}, w AS (SELECT vec_id, list_transform(range(0, 2), lambda k: CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding || embedding)[64 * k + i] > 0
    THEN (CASE WHEN i = 1 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) END) ELSE 0 END)) AS BIGINT)) AS words FROM e)
SELECT vec_id, words[1] AS word_1, words[2] AS word_2 FROM w""")
def sign_pack_wide(spark, folder):
    """Signs of vectors of 128 elements (each vector twice in a row) as two words."""
    wide = F.concat("embedding", "embedding")
    return _vectors(spark, folder).select("vec_id", vectors.sign_words(wide).alias("w")).select("vec_id", F.col("w")[0].alias("word_1"), F.col("w")[1].alias("word_2"))


@query()
def hash_encode_questions(spark, folder):
    """Deterministic token vectors of every distinct question, the stand-in for a model."""
    questions = table(spark, folder, "bench_questions").select(F.col("question_id").alias("query_id"), F.col("question").alias("text")).distinct()
    out = vectors.hash_encoder(questions, "query_id", "text")
    return out.select("query_id", "token_pos", F.round(vectors.norm(F.col("vec")), 5).alias("norm"))
