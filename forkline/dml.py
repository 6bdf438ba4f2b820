"""Insert, update and delete in a branch: each appends to the log and rewrites nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .catalog import MASTER, Catalog
from .errors import SemanticError
from .versioning import latest


def insert(catalog: Catalog, name: str, rows: DataFrame, branch: str = MASTER) -> None:
    """Append rows with new ids; columns go by name, and all are needed."""
    table = catalog.table(name)
    catalog.branch(branch)
    if sorted(rows.columns) != sorted(table.columns):
        raise SemanticError(f"'{name}' has the columns {table.columns}, not {rows.columns}")
    typed = rows.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema])
    # Ids are given once, as the rows are written; gaps don't matter.
    numbered = typed.withColumn("_tid", F.monotonically_increasing_id() + F.lit(table.next_tid))
    catalog.append(table, "inserts", numbered, branch)


def insert_values(catalog: Catalog, name: str, values: dict, branch: str = MASTER) -> None:
    """One row of Python values."""
    table = catalog.table(name)
    if sorted(values) != sorted(table.columns):
        raise SemanticError(f"'{name}' needs a value for each of {table.columns}")
    insert(catalog, name, catalog.spark.createDataFrame([tuple(values[c] for c in table.columns)], table.schema), branch)


def update(catalog: Catalog, name: str, assignments: dict[str, Column], where: Column | None = None, branch: str = MASTER) -> None:
    """New full images of the rows that the branch sees and the condition is true for."""
    table = catalog.table(name)
    if unknown := [c for c in assignments if c not in table.columns]:
        raise SemanticError(f"'{name}' has no columns {unknown}")
    rows = latest(catalog, name, branch)
    rows = rows if where is None else rows.where(where)
    kinds = {f.name: f.dataType for f in table.schema}
    images = rows.select("_tid", *[(assignments[c].cast(kinds[c]) if c in assignments else F.col(f"`{c}`")).alias(c) for c in table.columns], F.lit(False).alias("_deleted"))
    catalog.append(table, "changes", images, branch)


def delete(catalog: Catalog, name: str, where: Column | None = None, branch: str = MASTER) -> int:
    """Tombstones for the rows that the branch sees and the condition is true for; how many."""
    table = catalog.table(name)
    rows = latest(catalog, name, branch)
    rows = rows if where is None else rows.where(where)
    stones = rows.select("_tid", *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema], F.lit(True).alias("_deleted"))
    return catalog.append(table, "changes", stones, branch)[0]


def compact(catalog: Catalog, name: str) -> None:
    """Rewrites the log in few files: all inserts, and of the changes only the last one of each
    row and write stamp, as no branch, present or future, sees another. Earlier revisions
    within a stamp are given up, and rows of statements that failed are left out.

    The new log is a folder of its own; writing the metadata switches to it. Broken off
    before, the table is what it was; broken off after, only the old folder stays behind.
    """
    table = catalog.table(name)
    number, old, new, changed = next(catalog.seq), table.folders, dict(table.folders), table.changed
    for kind in ("inserts", "changes"):
        if not getattr(table, kind):
            continue
        schema = catalog.log_schema(table, kind)
        log = catalog.spark.read.schema(schema).parquet(catalog.part(table, kind))
        kept = catalog.ended(log, [s for _, _, s in getattr(table, kind)])
        if kind == "changes":
            kept = kept.groupBy("_tid", "_branch", "_epoch").agg(F.max_by(F.struct("_seq", "_deleted", *table.columns), "_seq").alias("v")).select("_tid", "_branch", "_epoch", "v.*")
        seen = Observation()
        written = kept.select(schema.fieldNames()).observe(seen, F.count(F.lit(1)).alias("n"))
        target = f"{kind}_{number}"
        # Few files, but no branch's rows in one task: the sizes decide at run time.
        written.hint("rebalance", "_branch").write.mode("overwrite").partitionBy("_branch").parquet(catalog.folder.path(name, target))
        if kind == "changes":
            changed = seen.get["n"]
        new[kind] = target
    before, orphans = table.changed, table.base_note.get("orphans", False)
    try:
        table.folders, table.changed, table.base_note["orphans"] = new, changed, False
        catalog.save()
    except BaseException:
        table.folders, table.changed, table.base_note["orphans"] = old, before, orphans
        raise
    for kind in old:
        if new[kind] != old[kind]:
            catalog.folder.delete(f"{name}/{old[kind]}")
