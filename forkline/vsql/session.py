"""Statements against a catalog: names are bound, then the DataFrame is built."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dml
from ..catalog import Catalog
from ..errors import SemanticError
from ..sources import copying
from ..types import declared, parse_literal, schema, sql_type
from ..versioning import resolve
from . import parser as P


class Session:
    """One database; sql() runs a statement and returns its rows, or None if it has none."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, strict_types: bool = False):
        self.spark, self.catalog, self.strict = spark, catalog or Catalog(spark), strict_types

    def sql(self, text: str) -> DataFrame | None:
        return self.run(P.parse(text))

    def script(self, text: str) -> list[DataFrame | None]:
        return [self.sql(s) for s in P.split(text)]

    def timed(self, text: str, fetch=None) -> tuple[DataFrame | None, dict[str, float]]:
        """Like sql(), with microseconds: parsing, planning (for statements without rows also
        their work) and running. The rows are computed once: with `fetch`, which is called
        with the frame, its result stands in the frame's place; otherwise they are thrown
        away, and the frame would compute them again."""
        t0 = time.perf_counter()
        tree = P.parse(text)
        t1 = time.perf_counter()
        out = df = self.run(tree)
        t2 = time.perf_counter()
        if df is not None and fetch:
            out = fetch(df)
        elif df is not None:
            df.write.format("noop").mode("overwrite").save()
        t3 = time.perf_counter()
        return out, {"parsing": (t1 - t0) * 1e6, "compilation": (t2 - t1) * 1e6, "execution": (t3 - t2) * 1e6}

    def run(self, s) -> DataFrame | None:
        c = self.catalog
        if isinstance(s, P.Select):
            return self.select(s)
        if isinstance(s, P.Insert):
            return self.insert(s)
        if isinstance(s, P.Update):
            self.branch_of(s)
            fields = self.fields(s.table)
            for name, _ in s.assignments:
                if name not in fields:
                    raise SemanticError(f"column '{name}' does not exist")
            dml.update(c, s.table, {n: self.value(v, fields[n]) for n, v in s.assignments}, self.filter(s), s.branch)
            return None
        if isinstance(s, P.Delete):
            self.branch_of(s)
            n = dml.delete(c, s.table, self.filter(s), s.branch)
            return self.spark.createDataFrame([(n,)], "deleted long")
        if isinstance(s, P.CreateTable):
            c.create_table(s.table, schema([(n, sql_type(t, a, nullable)) for n, t, a, nullable in s.columns]))
            return None
        if isinstance(s, P.CreateBranch):
            c.create_branch(s.name, s.parent)
            return None
        if isinstance(s, P.ListBranches):
            return c.branch_rows()
        if isinstance(s, P.Copy):
            self.branch_of(s)
            if s.to:
                copying.copy_to(c, s.table, s.path, s.format, s.branch)
            else:
                copying.copy_from(c, s.table, s.path, s.format)
            return None
        raise SemanticError(f"unknown statement {s}")

    def branch_of(self, s) -> None:
        self.catalog.table(s.table)
        self.catalog.branch(s.branch)

    def fields(self, table: str) -> dict:
        return {f.name: f for f in self.catalog.table(table).schema}

    def value(self, literal: P.Literal, field) -> Column:
        return F.lit(parse_literal(literal.text, declared(field))).cast(field.dataType)

    def filter(self, s) -> Column | None:
        fields, out = self.fields(s.table), []
        for name, literal in s.where:
            if name.table not in (None, s.table) or name.column not in fields:
                raise SemanticError(f"column '{name.column}' does not exist")
            out.append(F.col(f"`{name.column}`") == self.value(literal, fields[name.column]))
        return reduce(lambda a, b: a & b, out) if out else None

    def insert(self, s: P.Insert) -> None:
        self.branch_of(s)
        fields = self.fields(s.table)
        columns = s.columns or list(fields)
        for n in columns:
            if n not in fields:
                raise SemanticError(f"column '{n}' does not exist")
        if len(set(columns)) < len(columns):
            raise SemanticError("a column is named twice")
        if len(columns) != len(s.values) or len(columns) != len(fields):
            raise SemanticError(f"'{s.table}' has {len(fields)} columns, and {len(s.values)} values are given for {len(columns)}")
        dml.insert_values(self.catalog, s.table, {n: parse_literal(v.text, declared(fields[n])) for n, v in zip(columns, s.values)}, s.branch)

    def select(self, s: P.Select) -> DataFrame:
        """Filters first, then joins along the conditions, then the rest of these: every
        condition applies, and relations that nothing connects give all pairs."""
        frames: dict[str, DataFrame] = {}
        fields: dict[str, dict] = {}
        for r in s.relations:
            self.catalog.table(r.table)
            self.catalog.branch(r.branch)
            binding = r.alias or r.table
            if binding in frames:
                raise SemanticError(f"relation '{binding}' is there twice: give one an alias")
            df = resolve(self.catalog, r.table, r.branch)
            fields[binding] = self.fields(r.table)
            # Each column gets a name of its own, so that self joins stay unambiguous.
            frames[binding] = df.select([F.col(f"`{c}`").alias(f"{binding}.{c}") for c in df.columns])

        def bind(n: P.Name) -> tuple[str, str]:
            if n.table is not None:
                if n.table not in frames:
                    raise SemanticError(f"binding '{n.table}' does not exist")
                if n.column not in fields[n.table]:
                    raise SemanticError(f"column '{n.column}' does not exist in '{n.table}'")
                return n.table, n.column
            found = [b for b in frames if n.column in fields[b]]
            if len(found) > 1:
                raise SemanticError(f"column '{n.column}' is ambiguous")
            if not found:
                raise SemanticError(f"column '{n.column}' does not exist")
            return found[0], n.column

        def col(b: str, c: str) -> Column:
            return F.col(f"`{b}.{c}`")

        joins = []
        for left, right in s.where:
            b, c = bind(left)
            if isinstance(right, P.Literal):
                frames[b] = frames[b].where(col(b, c) == self.value(right, fields[b][c]))
                continue
            d, e = bind(right)
            x, y = fields[b][c].dataType, fields[d][e].dataType
            if self.strict and declared(fields[b][c]).spark() != declared(fields[d][e]).spark():
                raise SemanticError(f"cannot compare '{x.simpleString()}' and '{y.simpleString()}'")
            if b == d:
                frames[b] = frames[b].where(col(b, c) == col(d, e))
            else:
                joins.append(((b, c), (d, e)))

        rest = list(frames)
        joined = {rest.pop(0)}
        out = frames[next(iter(joined))]
        while rest:
            nxt = next((r for r in rest if any({b, d} <= joined | {r} and r in (b, d) for (b, _), (d, _) in joins)), rest[0])
            rest.remove(nxt)
            joined.add(nxt)
            now = [j for j in joins if {j[0][0], j[1][0]} <= joined]
            joins = [j for j in joins if j not in now]
            on = [col(*a) == col(*b) for a, b in now]
            out = out.join(frames[nxt], reduce(lambda a, b: a & b, on), "inner") if on else out.crossJoin(frames[nxt])
        wanted = [(b, c) for b in frames for c in fields[b]] if s.columns is None else [bind(n) for n in s.columns]
        return out.select([col(b, c).alias(c) for b, c in wanted])
