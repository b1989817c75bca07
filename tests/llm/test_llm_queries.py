"""The queries of the nine problems run over whole tables; those with SQL equal DuckDB's result."""

import pytest

from lexispark.llm.oracle import SQL
from lexispark.llm.queries import QUERIES
from tests.compare import connect, spark_rows, sql_rows

COLUMNS = {
    "p1_found": ["question_id", "unit_key"], "p2_found": ["question_id_a", "question_id_b"], "p3_found": ["chunk_id", "marker_start"],
    "p4_found": ["table_name", "id_a", "id_b"], "p5_found": ["id", "metric"], "p6_found": ["query_id", "hit_rank", "page_id"],
    "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = spark_rows(df)
    if name in SQL:
        assert got == sql_rows(connect(folder), SQL[name])
