"""Branches and versioned tables: the metadata, and where the rows lie.

A table is a base (any DataFrame with unique row ids, read where it lies, never copied)
and an append-only log in Parquet. The log has two parts: rows that were inserted, and
changes (new images of rows, or tombstones). A branch is metadata only: its id, its
parent's and its name. Ids grow, so the largest id at the time of a write is that write's
epoch, and a version is visible in a branch if the branch wrote it itself, or if an
ancestor wrote it before the branch's line forked from it.

Statements are numbered. Rows of a statement that didn't finish aren't visible, because a
statement's number counts only once the catalog says so; a repeated attempt gets another.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SemanticError
from .storage import Folder, shared_folder

MASTER = "master"
BOOKKEEPING = [T.StructField("_tid", T.LongType()), T.StructField("_branch", T.IntegerType()), T.StructField("_epoch", T.IntegerType()), T.StructField("_seq", T.LongType())]


@dataclass(frozen=True)
class Branch:
    id: int
    name: str
    parent: int | None


@dataclass
class Table:
    name: str
    schema: T.StructType
    created: int = 0  # statement number
    base: DataFrame | None = None  # _tid and the columns; rows of master as of `created`
    base_epoch: int = 0
    base_note: dict = field(default_factory=dict)  # orphans: a statement left rows without ending
    next_tid: int = 0
    inserts: list[tuple[int, int, int]] = field(default_factory=list)  # (branch, epoch, seq)
    changes: list[tuple[int, int, int]] = field(default_factory=list)
    changed: int = 0  # rows of all changes, however often each was changed
    folders: dict[str, str] = field(default_factory=lambda: {"inserts": "inserts", "changes": "changes"})

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


class Catalog:
    """All metadata of one database. Small: branches, tables, and a triple for each statement."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.folder = Folder(spark, root or shared_folder(spark))
        self.branches: dict[str, Branch] = {MASTER: Branch(0, MASTER, None)}
        self.tables: dict[str, Table] = {}
        self.seq = itertools.count(1)

    # Branches

    def branch(self, name: str) -> Branch:
        if name not in self.branches:
            raise SemanticError(f"branch '{name}' does not exist")
        return self.branches[name]

    def create_branch(self, name: str, parent: str | None = MASTER) -> Branch:
        """O(1), whatever the tables hold; a branch without a parent starts empty."""
        if name in self.branches:
            raise SemanticError(f"branch '{name}' already exists")
        made = Branch(len(self.branches), name, None if parent is None else self.branch(parent).id)
        self.branches[name] = made
        self.save()
        return made

    @property
    def epoch(self) -> int:
        return len(self.branches) - 1

    def by_id(self, n: int) -> Branch:
        return next(b for b in self.branches.values() if b.id == n)

    def lineage(self, name: str) -> list[tuple[int, int | None]]:
        """(ancestor, the child through which the branch descends from it), itself first with None."""
        b = self.branch(name)
        out: list[tuple[int, int | None]] = [(b.id, None)]
        while b.parent is not None:
            out.append((b.parent, b.id))
            b = self.by_id(b.parent)
        return out

    def visible(self, name: str, branch: int, epoch: int) -> bool:
        return any(branch == a and (child is None or epoch < child) for a, child in self.lineage(name))

    def visible_rows(self, name: str):
        """The same as a filter: literals only, so that it reaches partitions and row groups."""
        rule = F.lit(False)
        for a, child in self.lineage(name):
            own = F.col("_branch") == F.lit(a)
            rule = rule | (own if child is None else own & (F.col("_epoch") < F.lit(child)))
        return rule

    def branch_rows(self) -> DataFrame:
        """(branch, parent): what the BRANCH statement lists; roots aren't listed."""
        rows = [(b.name, self.by_id(b.parent).name) for b in self.branches.values() if b.parent is not None]
        return self.spark.createDataFrame(rows, "branch string, parent string")

    # Tables

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise SemanticError(f"table '{name}' does not exist")
        return self.tables[name]

    def create_table(self, name: str, schema: T.StructType) -> Table:
        if name in self.tables:
            raise SemanticError(f"table '{name}' already exists")
        names = [f.name for f in schema]
        if len(set(names)) < len(names):
            raise SemanticError(f"table '{name}' has a column twice")
        if clash := [n for n in names if n in ("_tid", "_branch", "_epoch", "_seq", "_deleted")]:
            raise SemanticError(f"column names {clash} are taken")
        self.tables[name] = Table(name, schema, next(self.seq))
        self.save()
        return self.tables[name]

    def register(self, name: str, df: DataFrame, key: str) -> Table:
        """A table of master over rows that lie elsewhere; `key` is a unique integer column
        and serves as the row id, so nothing is copied and ids are the same at every reading."""
        table = self.create_table(name, df.schema)
        table.base = df.select(F.col(key).cast("long").alias("_tid"), *df.columns)
        table.base_epoch, table.next_tid = self.epoch, 1 << 62  # ids of later rows
        return table

    def drop_table(self, name: str) -> None:
        """The table with its whole log."""
        self.table(name)
        del self.tables[name]
        self.save()
        self.folder.delete(name)

    # The log

    def part(self, table: Table, kind: str) -> str:
        return self.folder.path(table.name, table.folders[kind])

    def log_schema(self, table: Table, kind: str) -> T.StructType:
        extra = [T.StructField("_deleted", T.BooleanType())] if kind == "changes" else []
        return T.StructType([*BOOKKEEPING, *extra, *(T.StructField(f.name, f.dataType, True, f.metadata) for f in table.schema)])

    def log(self, table: Table, kind: str, branch: str) -> DataFrame | None:
        """The rows of one part of the log that a branch sees, or None if there are none."""
        seen = sorted(s for b, e, s in getattr(table, kind) if self.visible(branch, b, e))
        if not seen:
            return None
        df = self.spark.read.schema(self.log_schema(table, kind)).parquet(self.part(table, kind))
        df = df.where(self.visible_rows(branch))
        # Rows of a statement that failed may lie there; its number isn't among the table's.
        return self.ended(df, seen) if table.base_note.get("orphans") else df

    def ended(self, log: DataFrame, statements: list[int]) -> DataFrame:
        """The rows of these statements, however many there are: literals, or a join with
        their numbers (which the metadata holds anyway)."""
        if len(statements) <= 1000:
            return log.where(F.col("_seq").isin(statements))
        numbers = self.spark.createDataFrame([(s,) for s in statements], "_seq long")
        return log.join(F.broadcast(numbers), "_seq", "left_semi").select(log.columns)

    def append(self, table: Table, kind: str, rows: DataFrame, branch: str) -> tuple[int, int | None]:
        """Write the rows of one statement; they count once the triple is in the metadata.
        `rows` has _tid, the columns, and _deleted for changes. Gives the number of rows and
        their largest _tid, observed while they are written: the log isn't read back."""
        b, e, s = self.branch(branch).id, self.epoch, next(self.seq)
        before = table.base_note.get("orphans", False)
        table.base_note["orphans"] = True  # until it has ended
        names = self.log_schema(table, kind).fieldNames()
        full = rows.withColumns({"_branch": F.lit(b), "_epoch": F.lit(e), "_seq": F.lit(s).cast("long")}).select(names)
        seen = Observation()
        full = full.observe(seen, F.count(F.lit(1)).alias("n"), F.max("_tid").alias("top"))
        full.write.mode("append").partitionBy("_branch").parquet(self.part(table, kind))
        n, top = seen.get["n"], seen.get["top"]
        table.base_note["orphans"] = before
        getattr(table, kind).append((b, e, s))
        if kind == "changes":
            table.changed += n
        elif top is not None:
            table.next_tid = top + 1
        self.save()
        return n, top

    # Persistence

    def save(self) -> None:
        self.folder.write_text("catalog.json", json.dumps({
            "branches": [[b.id, b.name, b.parent] for b in self.branches.values()],
            "tables": [{"name": t.name, "schema": t.schema.json(), "created": t.created, "next_tid": t.next_tid, "base_epoch": t.base_epoch, "has_base": t.base is not None, "inserts": t.inserts, "changes": t.changes, "changed": t.changed, "folders": t.folders} for t in self.tables.values()],
        }))

    @classmethod
    def load(cls, spark: SparkSession, root: str, bases: dict[str, tuple[DataFrame, str]] | None = None) -> Catalog:
        """A saved database; `bases` gives again the rows of tables that lie elsewhere."""
        out = cls(spark, root)
        saved = json.loads(out.folder.read_text("catalog.json"))
        out.branches = {n: Branch(i, n, p) for i, n, p in saved["branches"]}
        last = 0
        for t in saved["tables"]:
            made = Table(t["name"], T.StructType.fromJson(json.loads(t["schema"])), t["created"], None, t["base_epoch"], {"orphans": True}, t["next_tid"], [tuple(x) for x in t["inserts"]], [tuple(x) for x in t["changes"]], t["changed"], t["folders"])
            if t["has_base"]:
                df, key = (bases or {})[t["name"]]
                made.base = df.select(F.col(key).cast("long").alias("_tid"), *df.columns)
            out.tables[made.name] = made
            last = max([last, made.created, *(s for _, _, s in made.inserts + made.changes)])
        out.seq = itertools.count(last + 1_000)  # past anything that an unfinished statement left
        return out

    def graph(self, counts: bool = False) -> dict:
        """Nodes and links of the branches; with `counts` the rows that each branch sees."""
        from .versioning import resolve

        def rows(b: Branch) -> int:
            return sum(resolve(self, t, b.name).count() for t in self.tables) if counts else 0

        return {"nodes": [{"name": b.name, "id": b.id, "tuples": rows(b)} for b in self.branches.values()], "links": [{"source": b.parent, "target": b.id, "weight": 1} for b in self.branches.values() if b.parent is not None]}
