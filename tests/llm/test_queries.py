import pytest

from tests.oracle import duckdb_rows, spark_rows
from vertexloom.llm import entries


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(entries.queries()[name](spark, sf)) == duckdb_rows(sf, entries.oracle_sql()[name])
