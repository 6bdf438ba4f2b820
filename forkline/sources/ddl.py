"""Schema files: CREATE TABLE with keys and CREATE INDEX, to Spark schemas.

Keys and indexes are kept as metadata; nothing enforces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SyntacticalError
from ..types import SqlType, schema, sql_type
from .copying import read_separated

_TOKEN = re.compile(r"--[^\n]*|\"[^\"]*\"|[A-Za-z_]\w*|\d+|[(),;]|\s+|.")


@dataclass
class Relation:
    name: str
    columns: list[tuple[str, SqlType]]
    primary_key: list[str] = field(default_factory=list)

    def spark(self) -> T.StructType:
        return schema(self.columns)


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]


@dataclass
class Schema:
    relations: dict[str, Relation] = field(default_factory=dict)
    indexes: list[Index] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row for each column: what the file declares."""
        rows = [(r.name, k, n, str(t), t.nullable, n in r.primary_key) for r in self.relations.values() for k, (n, t) in enumerate(r.columns)]
        return spark.createDataFrame(rows, "relation string, position int, column string, type string, nullable boolean, in_key boolean")


class _Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if not t.isspace() and not t.startswith("--")]
        self.at = 0

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise SyntacticalError("the schema ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> bool:
        if [t.lower() for t in self.tokens[self.at : self.at + len(words)]] == list(words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntacticalError(f"'{' '.join(words)}' is expected before '{' '.join(self.tokens[self.at:self.at + 3])}'")

    def name(self) -> str:
        t = self.next()
        if not re.match(r"[\"A-Za-z_]", t):
            raise SyntacticalError(f"a name is expected, not '{t}'")
        return t.strip('"')

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out


def parse_schema(text: str) -> Schema:
    r, out = _Reader(text), Schema()
    while r.at < len(r.tokens):
        if r.take(";"):
            continue
        r.need("create")
        unique = r.take("unique")
        if r.take("index"):
            name = r.name()
            r.need("on")
            out.indexes.append(Index(name, r.name(), r.names()))
        elif unique:
            raise SyntacticalError("only an index can be unique")
        else:
            r.need("table")
            relation = Relation(r.name(), [])
            r.need("(")
            while True:
                if r.take("primary", "key"):
                    relation.primary_key = r.names()
                else:
                    relation.columns.append(_column(r, relation))
                if not r.take(","):
                    break
            r.need(")")
            if relation.name in out.relations:
                raise SyntacticalError(f"table '{relation.name}' is there twice")
            out.relations[relation.name] = relation
    return out


def _column(r: _Reader, relation: Relation) -> tuple[str, SqlType]:
    name, kind, numbers = r.name(), r.next(), []
    if r.take("("):
        numbers.append(int(r.next()))
        while r.take(","):
            numbers.append(int(r.next()))
        r.need(")")
    nullable = True
    while True:
        if r.take("not", "null"):
            nullable = False
        elif r.take("primary", "key"):
            relation.primary_key = [name]
        elif not r.take("null"):
            return name, sql_type(kind, tuple(numbers), nullable)


def load_database(spark: SparkSession, declared: Schema, folder: str) -> dict[str, DataFrame]:
    """Each relation's rows from <folder>/<relation>.tbl."""
    return {n: read_separated(spark, f"{folder}/{n}.tbl", r.spark(), "tbl") for n, r in declared.relations.items()}
