import pytest

import __spark_entry__
from tests.oracle import duckdb_rows, spark_rows
from vertexloom import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(entries.queries()[name](spark, SF)) == duckdb_rows(SF, entries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(entries.queries()) - set(entries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entries.queries()["filter_eq_string"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan


def test_ordered_rows_are_in_order(spark):
    keys = [r["v0_k"] for r in entries.queries()["ordered_rows"](spark, SF).collect()]
    assert keys == sorted(keys) and len(keys) > 20
