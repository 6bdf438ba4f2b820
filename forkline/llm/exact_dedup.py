"""Exact dedup by skew-safe combining.

Rows are first deduplicated within their partition (the map-side half of the first
aggregation), then the partitions' winners are merged by salted digest, so that a text with
millions of copies is spread over `salts` reducers, then the salts' winners are combined.
Both aggregations have the whole text among their keys: a digest alone never decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small, written


def _unhashable(kind: T.DataType) -> bool:
    """Whether Spark has no hash of the type: maps and variants, inside others too."""
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each group of equal texts, with all columns of `docs` and `n_copies` (under
    a name that is free): the row with the smallest id, nulls last; among rows of one id, the
    one whose columns have the smallest hash (rows equal in all columns are the same).

    A null text equals no other: such rows all stay, with 1. Empty texts are equal to each
    other. An empty table gives an empty result. Columns may be of any type, maps too.

    Texts that share their digest with no other row need no comparison. If the digests that
    repeat are few enough to broadcast (`broadcast_rows`), only their rows' texts are
    shuffled; beyond that all rows pass the same two aggregations.
    """
    n_copies = fresh("n_copies", docs)
    h1, h2, salt, order, rest, size = (fresh(f"_{x}", docs) for x in ("h1", "h2", "salt", "order", "rest", "size"))
    text = docs[text_col]
    others = [c for c in docs.columns if c != text_col]
    hashable = [F.to_json(F.struct(c)) if _unhashable(docs.schema[c].dataType) else F.col(c) for c in others]
    keyed = docs.withColumns({h1: F.when(text.isNotNull(), F.xxhash64(text)), h2: F.when(text.isNotNull(), F.hash(text))})

    twice = written(keyed.where(F.col(h1).isNotNull()).groupBy(h1, h2).count().where("count > 1").drop("count"))
    if small(twice, broadcast_rows):
        ask, alone = keyed.join(F.broadcast(twice), [h1, h2], "left_semi"), keyed.join(F.broadcast(twice), [h1, h2], "left_anti")
    else:
        ask, alone = keyed.where(F.col(h1).isNotNull()), keyed.where(F.col(h1).isNull())

    row = ask.select(
        h1, h2, text_col,
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias(salt),
        F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.xxhash64(*hashable).alias("c")).alias(order),
        F.struct(*others).alias(rest),
    )
    salted = row.groupBy(h1, h2, salt, text_col).agg(F.min_by(rest, order).alias(rest), F.min(order).alias(order), F.count(F.lit(1)).alias(size))
    whole = salted.groupBy(h1, h2, text_col).agg(F.min_by(rest, order).alias(rest), F.sum(size).alias(n_copies))
    winners = whole.select(*[F.col(text_col) if c == text_col else F.col(rest)[c].alias(c) for c in docs.columns], n_copies)
    return alone.select(*docs.columns, F.lit(1).cast("long").alias(n_copies)).unionByName(winners)
