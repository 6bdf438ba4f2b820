"""The logical algebra: scans, filters, computed columns, joins, grouping and their aggregates.

Thin on purpose: each function builds the DataFrame operator, and the planner does the rest.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..functions.numeric import average

COMPARISONS = {"<": operator.lt, "<=": operator.le, "=": operator.eq, ">=": operator.ge, ">": operator.gt}


def compare(mode: str, left: Column, right: Column) -> Column:
    """One of the five comparisons; a null operand gives null."""
    if mode not in COMPARISONS:
        raise SemanticError(f"unknown comparison '{mode}'")
    return COMPARISONS[mode](left, right)


def conjunction(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def disjunction(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def negation(condition: Column) -> Column:
    return ~condition


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is true."""
    return df.where(conjunction(*conditions))


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Named columns, or all with '*', in the order asked for; repeated ones stay."""
    return df.select(*columns)


def map_columns(df: DataFrame, **expressions: Column) -> DataFrame:
    return df.withColumns(expressions)


def check_comparable(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> None:
    """Strict mode: keys compare only with keys of the same type."""
    for a, b in on:
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if x != y:
            raise SemanticError(f"cannot compare '{x.simpleString()}' and '{y.simpleString()}'")


def join(left: DataFrame, right: DataFrame, on: list[tuple[str | Column, str | Column]], strict: bool = False) -> DataFrame:
    """Inner equi-join; keys are column names or expressions."""
    if not on:
        raise SemanticError("a join needs a key; use cross() for all pairs")
    if strict:
        check_comparable(left, right, [(a, b) for a, b in on if isinstance(a, str) and isinstance(b, str)])
    return left.join(right, [(left[a] if isinstance(a, str) else a) == (right[b] if isinstance(b, str) else b) for a, b in on], "inner")


#: Rows that join_pairs() packs into one.
BLOCK = 4096


def _named(df: DataFrame, keys: list[str], side: str) -> tuple[list[Column], list[str]]:
    """The keys as k0, k1 and so on, the other columns as {side}0 and so on; and the names these had."""
    rest = [c for c in df.columns if c not in keys]
    return [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(f"`{c}`").alias(f"{side}{i}") for i, c in enumerate(rest)], rest


def join_pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], block: int = BLOCK) -> DataFrame:
    """Inner equi-join for keys that many rows of both sides share, whose result is therefore
    far larger than its input; `right` is the side with fewer rows. join() puts all pairs of a
    key into one task, and as tasks are made by bytes of input, often those of all keys. Here
    the rows of `left` are spread over all tasks, whatever their keys are, and each task gets
    the rows of `right`, `block` of a key packed into one. `left` is moved once and `right` once
    a task, pairs aren't; a task holds the pairs of one row of `left` at a time.

    The result has the columns besides the keys, which are of the same type on both sides."""
    if not on:
        raise SemanticError("a join needs a key; use cross() for all pairs")
    check_comparable(left, right, on)
    (l_named, l_rest), (r_named, r_rest) = _named(left, [a for a, _ in on], "l"), _named(right, [b for _, b in on], "r")
    keys, given = [f"k{i}" for i in range(len(on))], conjunction(*[F.col(f"k{i}").isNotNull() for i in range(len(on))])
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    # Hashes and numbers come from the rows themselves: a task that runs again gives the same.
    rows = left.select(*l_named).where(given)
    rows = rows.withColumn("task", F.pmod(F.xxhash64(*rows.columns), F.lit(tasks)))
    others = right.select(*r_named, F.lit(0).alias("filled")).where(given)
    fields = [c for c in others.columns if c not in keys]
    row = F.struct(*fields)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(row))
    blocks = others.select(*keys, row.alias("row"), F.floor((number - 1) / block).alias("block")).groupBy(*keys, "block").agg(F.collect_list("row").alias("rows"))
    blocks = blocks.select(*keys, *[F.col("rows")[c].alias(c) for c in fields], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"))

    # With a number of its own a shuffle isn't put together into fewer tasks. Without the hint
    # the planner, to which explode() adds no rows, may broadcast what is for all tasks.
    pairs = rows.repartition(tasks, "task", *keys).join(blocks.repartition(tasks, "task", *keys).hint("merge"), ["task", *keys], "inner")
    first, ls = fields[0], [f"l{i}" for i in range(len(l_rest))]
    pairs = pairs.select(*ls, *fields[1:], F.posexplode(first).alias("at", "one"))
    values = [F.col("one") if f == first else F.get(f, "at") for f in fields[: len(r_rest)]]
    return pairs.select(*[F.col(c).alias(n) for c, n in zip(ls, l_rest)], *[v.alias(n) for v, n in zip(values, r_rest)])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


# Aggregates: (kind, column) pairs that group_by() turns into one aggregation.


def keep(column: str):
    return "keep", F.col(column), column


def sum_of(expression: Column, name: str):
    return "agg", F.sum(expression), name


def avg_of(expression: Column, name: str, scale: int = 4):
    """The average as a numeric with `scale` fraction digits, cut off (4 for whole numbers,
    its own for a numeric)."""
    return "agg", average(expression, scale), name


def count_all(name: str):
    return "agg", F.count(F.lit(1)), name


def min_of(expression: Column, name: str):
    return "agg", F.min(expression), name


def group_by(df: DataFrame, *items) -> DataFrame:
    """Grouped by the kept columns; without any, one row for the whole input (also if that is empty)."""
    keys = [c.alias(n) for kind, c, n in items if kind == "keep"]
    aggs = [c.alias(n) for kind, c, n in items if kind == "agg"]
    if not aggs:
        return df.select(*keys).distinct()
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return out.select(*[n for _, _, n in items])
