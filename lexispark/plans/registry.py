"""The queries of the engine, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from lexispark.plans import (  # noqa: E402, F401
    answering_queries,
    calibration_queries,
    event_queries,
    lexical_queries,
    list_queries,
    quality_queries,
    review_queries,
    source_queries,
    star_queries,
    structure_queries,
    vector_queries,
)
