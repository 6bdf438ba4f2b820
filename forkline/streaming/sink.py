"""Result sinks: rows to a callback, or printed. (Continuous queries aren't part of this engine.)"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from ..types import declared, show


def for_each(df: DataFrame, callback: Callable[[Row], None]) -> int:
    """Calls back on the driver for one row after another, a partition in memory at a time; how many."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        callback(row)
        n += 1
    return n


def for_each_on_executors(df: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls back where the rows are, at least once for each: a lost task calls again."""

    def run(rows):
        for r in rows:
            callback(r)

    df.foreachPartition(run)


def tuple_text(row: Row) -> str:
    return "(" + ", ".join(map(show, row)) + ")"


def print_rows(df: DataFrame, out=None) -> int:
    """Tab-separated rows, and how many there were."""
    out = out or sys.stdout
    kinds = [declared(f) for f in df.schema]
    n = for_each(df, lambda r: print(*(show(v, k) for v, k in zip(r, kinds)), sep="\t", file=out))
    print(f"Produced {n} tuples" if n else "Empty result set", file=out)
    return n
