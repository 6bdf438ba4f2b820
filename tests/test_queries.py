"""Every named query against its SQL."""

import pytest

from forkline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, data):
    plan = catalogue.QUERIES["select_and"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in plan
