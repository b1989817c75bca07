"""Inputs that several queries share, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.cluster import distinct_rows
from lexispark.functions.text import FOLD_FROM, FOLD_TO, FOLDED_STOPWORDS, LOWER_FROM, LOWER_TO, MIN_TOKEN_CHARS, PREFIX
from lexispark.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in FOLDED_STOPWORDS)


def sql_lower(x: str) -> str:
    return f"lower(translate({x}, '{LOWER_FROM}', '{LOWER_TO}'))"


def sql_tokens(x: str) -> str:
    """SQL of ``tokenize``."""
    words = f"regexp_extract_all({sql_lower(f'coalesce({x}, chr(32))')}, '[\\p{{L}}\\p{{N}}_]+')"
    words = f"list_filter({words}, lambda w: length(w) >= {MIN_TOKEN_CHARS})"
    words = f"list_transform({words}, lambda w: translate(w, '{FOLD_FROM}', '{FOLD_TO}'))"
    words = f"list_filter({words}, lambda w: w NOT IN ({_STOP}))"
    return f"list_transform({words}, lambda w: substring(w, 1, {PREFIX}))"


# searches ask the questions whose number is divisible by 20, against all rows
QUESTIONS_SQL = "qs AS (SELECT DISTINCT question_id AS query_id, question AS text FROM bench_questions WHERE CAST(substr(question_id, 2) AS BIGINT) % 20 = 0)"
ALL_QUESTIONS_SQL = "qs AS (SELECT DISTINCT question_id AS query_id, question AS text FROM bench_questions WHERE question_id IS NOT NULL)"
UNITS_SQL = "units AS (SELECT DISTINCT chunk_id AS page_id, coalesce(index_text, '') AS text FROM chunks WHERE chunk_id IS NOT NULL)"
GOLD_SQL = "gold AS (SELECT DISTINCT question_id AS query_id, unnest(gold_page_ids) AS page_id FROM bench_questions)"


def search_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of searches."""
    rows = table(spark, folder, "bench_questions").select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    return rows.where(F.substring("query_id", 2, 20).cast("long") % 20 == 0).distinct()


def all_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every question as a query, each once."""
    rows = table(spark, folder, "bench_questions").where("question_id is not null")
    return rows.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")).distinct()


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as units of retrieval, each once."""
    rows = table(spark, folder, "chunks").where("chunk_id is not null")
    return distinct_rows(rows.select(F.col("chunk_id").alias("page_id"), F.coalesce("index_text", F.lit("")).alias("text")), ["page_id"], "text")


def gold_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Gold pages of every question."""
    rows = table(spark, folder, "bench_questions")
    return rows.select(F.col("question_id").alias("query_id"), F.explode("gold_page_ids").alias("page_id")).distinct()


def _list_sql(name: str, score: str) -> str:
    return f"""{name} AS (
    SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page_id) AS rank
    FROM (SELECT query_id, page_id, max({score}) AS s FROM page_hits
          WHERE {score} IS NOT NULL AND NOT isnan({score}) AND query_id IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL))"""


HITS_SQL = _list_sql("hits", "score")
VISUAL_SQL = _list_sql("visual", "visual_score")


def hit_list(spark: SparkSession, folder: str, score: str = "score", limit: int | None = None) -> DataFrame:
    """Rank list of every query from the hit table: best score of a page, null and NaN left out."""
    from lexispark.operators.lexical import rank_pages

    rows = table(spark, folder, "page_hits").where(F.col(score).isNotNull() & ~F.isnan(score) & F.col("query_id").isNotNull() & F.col("page_id").isNotNull())
    best = rows.groupBy("query_id", "page_id").agg(F.max(score).alias("score"))
    return rank_pages(best, limit).select("query_id", "page_id", "rank")


def sql_upper_bound(source: str, key: str, name: str = "cp", alpha: float = 0.05) -> str:
    """CTEs that end in ``name`` (key, upper): the Clopper-Pearson bound of ``errors`` in ``n`` of every row of ``source``."""
    return f"""{name}_steps AS (
    SELECT {key} AS key, CAST(errors AS BIGINT) AS k, CAST(n AS BIGINT) AS n, 0 AS i, errors / n AS lo, CAST(1 AS DOUBLE) AS hi FROM {source} WHERE errors > 0 AND errors < n
    UNION ALL SELECT key, k, n, i + 1, CASE WHEN cdf > {alpha} THEN mid ELSE lo END, CASE WHEN cdf > {alpha} THEN hi ELSE mid END
    FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS cdf
          FROM {name}_steps WHERE i < 50)),
{name} AS (
    SELECT t.{key} AS key, CASE WHEN t.n = 0 THEN NULL WHEN t.errors = t.n THEN 1 WHEN t.errors = 0 THEN 1 - pow({alpha}, 1.0 / t.n) ELSE (s.lo + s.hi) / 2 END AS upper
    FROM {source} t LEFT JOIN (SELECT * FROM {name}_steps WHERE i = 50) s ON s.key IS NOT DISTINCT FROM t.{key})"""
