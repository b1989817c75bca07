"""Sources and sinks: CSV manifests, JSON lines, text layers, event logs, resumable jobs, verdict caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "doc_id string, doc_name string, doc_type string, url string"
# The document types a manifest may name.
DOC_TYPES = ("kanun", "rg_tarihi")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with ``problem``: what is wrong with a row, null if nothing is."""
    rows = spark.read.csv(path, header=True, schema=f"{MANIFEST_SCHEMA}, _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.withColumn("problem", manifest_problem(F.col("doc_id"), F.col("doc_name"), F.col("doc_type"), F.col("url"))).withColumn(
        "problem", F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable")).otherwise(F.col("problem"))
    ).drop("_corrupt")


def manifest_problem(doc_id: Column, doc_name: Column, doc_type: Column, url: Column) -> Column:
    """First broken rule of a manifest row, null if none is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(doc_id), "doc_id")
        .when(blank(doc_name), "doc_name")
        .when(~F.coalesce(doc_type, F.lit("")).isin(*DOC_TYPES), "doc_type")
        .when(blank(url), "url")
    )


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a fixed schema; unreadable lines keep their text in ``_corrupt``."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the result appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def with_all_ids(ids: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Exactly one row per requested id; a missing text is empty."""
    one = texts.groupBy(key).agg(F.max(text).alias(text))
    return ids.select(key).distinct().join(one, key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def extract_text_layer(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``path``, ``page_no``, ``text``, ``problem`` from the content of binary files.

    A file that cannot be read gives one row with an empty text, no page number and the error in ``problem``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.extend([(path, i, t, None) for i, t in enumerate(extract(bytes(content)), 1)])
                except Exception as error:  # noqa: BLE001 - a broken file must not end the job
                    rows.append((path, None, "", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "problem"]).astype({"page_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string, problem string")


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pages and blank pages per document."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(blank).alias("blank"))


def merge_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def export_events(events: DataFrame, path: str) -> None:
    """Events ordered by id, as Parquet or CSV by the ending of the path; nested columns become JSON in CSV."""
    ordered = events.orderBy("id")
    if path.endswith(".csv"):
        ordered.select(*[F.to_json(c).alias(c) if ":" in t or "<" in t else F.col(c) for c, t in ordered.dtypes]).write.mode("overwrite").csv(path, header=True)
    else:
        ordered.write.mode("overwrite").parquet(path)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key was not written yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    """Content address of a verdict: SHA-256 over the parts with a separator that no text holds."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests without a parsed verdict in the cache."""
    return requests.join(cache.where("parsed").select(key).distinct(), key, "left_anti")
