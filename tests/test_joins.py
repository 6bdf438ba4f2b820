"""Joins whose keys many rows of both sides share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from forkline.errors import SemanticError
from forkline.operators import algebra as A
from forkline.plans import catalogue

LEFT = [(1, "x", 1, "a"), (1, "x", 2, None), (1, "x", 2, None), (1, "x", None, "b"), (1, "y", 3, "c"), (2, "x", 4, "d"), (None, "x", 5, "e"), (3, None, 6, "f"), (7, "q", 7, "g")]
RIGHT = [(1, "x", 10 * i, str(i)) for i in range(7)] + [(1, "x", None, None), (1, "x", 0, "0"), (2, "x", 1, None), (None, "x", 2, "n"), (3, None, 3, "n"), (8, "q", 4, "o")]


@pytest.mark.parametrize("block", [1, 3, 9, A.BLOCK])
@pytest.mark.parametrize("left, right", [(LEFT, RIGHT), ([], RIGHT), (LEFT, [])])
def test_pairs_are_those_of_a_join(spark, left, right, block):
    want = Counter((*a[2:], *b[2:]) for a in left for b in right if None not in a[:2] and a[:2] == b[:2])
    a, b = spark.createDataFrame(left, "k int, j string, v int, `a b` string"), spark.createDataFrame(right, "m int, n string, w int, z string")
    got = A.join_pairs(a, b, [("k", "m"), ("j", "n")], block)
    assert got.columns == ["v", "a b", "w", "z"] and Counter(map(tuple, got.collect())) == want
    counted = A.join_pairs(a.select("k", "j", "v"), b.select("m", "n"), [("k", "m"), ("j", "n")], block)
    assert counted.columns == ["v"] and Counter(r.v for r in counted.collect()) == Counter(p[0] for p in want.elements())


def test_pairs_need_keys_of_one_type(spark):
    a, b = spark.range(1), spark.range(1).select(F.col("id").cast("int").alias("x"))
    with pytest.raises(SemanticError):
        A.join_pairs(a, b, [("id", "x")])
    with pytest.raises(SemanticError):
        A.join_pairs(a, b, [])


@pytest.mark.parametrize("nations", [1, 3])
def test_pairs_of_a_nation_are_spread_over_the_tasks(spark, tmp_path, nations):
    """They were all made in one task, however many there were."""
    i = F.col("id")
    spark.range(2000).select(i.alias("c_custkey"), (i % nations).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(90).select(i.alias("s_suppkey"), (i % nations).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(nations).select(i.cast("int").alias("n_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    pairs = catalogue.QUERIES["join_cycle"](spark, str(tmp_path))
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 * 90 // nations and max(tasks) < sum(tasks) / 2
    assert pairs.distinct().count() == sum(tasks)
    # What all tasks get isn't collected by the driver, however little the planner thinks it is.
    assert "SortMergeJoin" in pairs._jdf.queryExecution().executedPlan().toString()
