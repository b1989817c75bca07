"""Every query runs; those with SQL equal DuckDB's result on the same tables."""

import pytest

from lexispark.plans.registry import QUERIES, SQL
from tests.compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    got = spark_rows(QUERIES[name](spark, folder))
    if name in SQL:
        assert got == sql_rows(con, SQL[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "page_id", "hit_rank", "score", "doc_name", "source_url", "above_floor"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
