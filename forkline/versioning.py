"""Reading branches: the latest rows, the earliest ones, earlier revisions, differences.

The latest view is merge-on-read. Inserted rows keep their one image unless the branch sees
a change of them, so the large side (base and inserts) is only filtered, and dropped where
the few changes name its rows; of the changes the last one for each row is taken. Without a
visible change the view is a plain scan. A filter on user columns applies to the view, not
to versions: an older image never comes back because it happens to match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import MASTER, Catalog, Table
from .errors import SemanticError


#: So many ids of changed rows (eight bytes each; the metadata counts them) are sent to every
#: task at most, so that a base with few changes isn't shuffled; beyond it both sides are.
SENT_IDS = 2_000_000


def _first_images(catalog: Catalog, table: Table, branch: str) -> DataFrame:
    """_tid, _seq and the columns of every row's first image that the branch sees."""
    parts = []
    if table.base is not None and catalog.visible(branch, 0, table.base_epoch):
        parts.append(table.base.select("_tid", F.lit(table.created).cast("long").alias("_seq"), *table.columns))
    log = catalog.log(table, "inserts", branch)
    if log is not None:
        parts.append(log.select("_tid", "_seq", *table.columns))
    if not parts:
        return catalog.spark.createDataFrame([], catalog.log_schema(table, "inserts")).select("_tid", "_seq", *table.columns)
    return reduce(DataFrame.unionByName, parts)


def _last_changes(catalog: Catalog, table: Table, branch: str) -> DataFrame | None:
    log = catalog.log(table, "changes", branch)
    if log is None:
        return None
    image = F.struct("_seq", "_deleted", *table.columns)
    return log.groupBy("_tid").agg(F.max_by(image, "_seq").alias("v")).select("_tid", "v.*")


def latest(catalog: Catalog, name: str, branch: str = MASTER) -> DataFrame:
    """_tid, _seq and the columns of the rows that are live in the branch."""
    table = catalog.table(name)
    first, last = _first_images(catalog, table, branch), _last_changes(catalog, table, branch)
    if last is None:
        return first
    # Every row that has a change, live or not: their ids only, which needn't be different.
    ids = catalog.log(table, "changes", branch).select("_tid")
    untouched = first.join(F.broadcast(ids) if table.changed <= SENT_IDS else ids, "_tid", "left_anti")
    return untouched.unionByName(last.where(~F.col("_deleted")).drop("_deleted"))


def resolve(catalog: Catalog, name: str, branch: str = MASTER, with_tid: bool = False) -> DataFrame:
    """The table as the branch sees it."""
    table = catalog.table(name)
    return latest(catalog, name, branch).select(*(["_tid"] if with_tid else []), *table.columns)


def versions(catalog: Catalog, name: str, branch: str = MASTER) -> DataFrame:
    """Every version of the live rows that the branch sees: _tid, _seq, the columns. Only
    visible ones: what an ancestor wrote after the fork isn't part of a branch's history."""
    table = catalog.table(name)
    first, log = _first_images(catalog, table, branch), catalog.log(table, "changes", branch)
    if log is None:
        return first
    dead = _last_changes(catalog, table, branch).where("_deleted").select("_tid")
    return first.unionByName(log.where(~F.col("_deleted")).select("_tid", "_seq", *table.columns)).join(dead, "_tid", "left_anti")


def earliest(catalog: Catalog, name: str, branch: str = MASTER, with_tid: bool = False) -> DataFrame:
    """The first visible version of each live row."""
    table = catalog.table(name)
    last = _last_changes(catalog, table, branch)
    first = _first_images(catalog, table, branch)
    if last is not None:
        first = first.join(last.where("_deleted").select("_tid"), "_tid", "left_anti")
    return first.select(*(["_tid"] if with_tid else []), *table.columns)


def revision(catalog: Catalog, name: str, back: int, branch: str = MASTER, with_tid: bool = False) -> DataFrame:
    """The version that many writes before the latest; rows without so many are left out."""
    if back < 0:
        raise SemanticError("a revision is 0 or more writes back")
    table = catalog.table(name)
    ranked = versions(catalog, name, branch).withColumn("_n", F.row_number().over(Window.partitionBy("_tid").orderBy(F.desc("_seq"))))
    return ranked.where(F.col("_n") == back + 1).select(*(["_tid"] if with_tid else []), *table.columns)


def history(catalog: Catalog, name: str, branch: str = MASTER) -> DataFrame:
    """(_tid, n_versions) of the live rows."""
    return versions(catalog, name, branch).groupBy("_tid").agg(F.count(F.lit(1)).alias("n_versions"))


def point(catalog: Catalog, name: str, tid: int, branch: str = MASTER) -> DataFrame:
    """One live row by its id; the filter passes the merge, as it is on the row id."""
    return resolve(catalog, name, branch, with_tid=True).where(F.col("_tid") == F.lit(tid)).drop("_tid")


def is_visible(catalog: Catalog, name: str, tid: int, branch: str = MASTER) -> bool:
    return not point(catalog, name, tid, branch).isEmpty()


def diff(catalog: Catalog, name: str, left: str, right: str) -> DataFrame:
    """_tid and `change` of the rows that differ: only in the left, only in the right, or changed."""
    columns = catalog.table(name).columns
    a = resolve(catalog, name, left, with_tid=True).select("_tid", F.struct(*columns).alias("a"))
    b = resolve(catalog, name, right, with_tid=True).select("_tid", F.struct(*columns).alias("b"))
    both = a.join(b, "_tid", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("_tid", F.when(F.col("b").isNull(), f"only {left}").when(F.col("a").isNull(), f"only {right}").otherwise("changed").alias("change"))
