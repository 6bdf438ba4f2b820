"""SQL column types: their Spark types, and the reading and printing of their values."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from .errors import SemanticError


@dataclass(frozen=True)
class SqlType:
    name: str
    length: int | None = None
    precision: int | None = None
    nullable: bool = False

    def spark(self) -> T.DataType:
        if self.name == "numeric":
            length = min(self.length or 18, 38)
            return T.DecimalType(length, min(self.precision or 0, length))
        return _SPARK[self.name]()

    def __str__(self) -> str:
        inner = ",".join(str(x) for x in (self.length, self.precision) if x is not None)
        return f"{self.name}({inner})" if inner else self.name


_SPARK = {"bool": T.BooleanType, "integer": T.IntegerType, "longinteger": T.LongType, "char": T.StringType, "varchar": T.StringType, "text": T.StringType, "date": T.DateType, "timestamp": T.TimestampNTZType}

#: Spellings that DDL accepts, and how many numbers each takes in parentheses.
SPELLINGS = {"bool": ("bool", 0), "boolean": ("bool", 0), "int": ("integer", 0), "integer": ("integer", 0), "longinteger": ("longinteger", 0), "bigint": ("longinteger", 0), "numeric": ("numeric", 2), "decimal": ("numeric", 2), "char": ("char", 1), "varchar": ("varchar", 1), "text": ("text", 0), "date": ("date", 0), "timestamp": ("timestamp", 0)}


def sql_type(name: str, args: tuple[int, ...] = (), nullable: bool = False) -> SqlType:
    if name.lower() not in SPELLINGS:
        raise SemanticError(f"unknown type '{name}'")
    base, most = SPELLINGS[name.lower()]
    if len(args) > most:
        raise SemanticError(f"type '{name}' takes {most} numbers at most")
    length = args[0] if args else (1 if base == "char" else 18 if base == "numeric" else None)
    precision = (args[1] if len(args) > 1 else 0) if base == "numeric" else None
    if precision is not None and precision > length:
        raise SemanticError(f"'{name}' has more fraction digits than digits")
    return SqlType(base, length, precision, nullable)


def schema(columns: list[tuple[str, SqlType]]) -> T.StructType:
    """A Spark schema that keeps the declared types as metadata."""
    return T.StructType([T.StructField(n, t.spark(), t.nullable, {"sql_type": t.name, "length": t.length, "precision": t.precision}) for n, t in columns])


def declared(field: T.StructField) -> SqlType:
    """The declared type of a column, or the nearest one for columns from elsewhere."""
    m = field.metadata or {}
    if "sql_type" in m:
        return SqlType(m["sql_type"], m.get("length"), m.get("precision"), field.nullable)
    k = field.dataType
    if isinstance(k, T.DecimalType):
        return SqlType("numeric", k.precision, k.scale, field.nullable)
    for name, kind in (("bool", T.BooleanType), ("integer", T.IntegerType), ("longinteger", T.LongType), ("date", T.DateType), ("timestamp", T.TimestampNTZType), ("timestamp", T.TimestampType)):
        if isinstance(k, kind):
            return SqlType(name, nullable=field.nullable)
    return SqlType("text", nullable=field.nullable)


def parse_literal(text: str, kind: SqlType):
    """A literal's value. Integers stop at a decimal point; fraction digits beyond the
    declared ones are an error unless they are zeros; a timestamp's fraction counts
    milliseconds; strings longer than declared don't match the type."""
    s = text.strip(" ") if kind.name not in ("char", "varchar", "text") else text
    if kind.name == "bool":
        if s not in ("true", "false"):
            raise SemanticError(f"'{text}' is no boolean: true or false")
        return s == "true"
    if kind.name in ("integer", "longinteger"):
        m = re.fullmatch(r"([+-]?\d{1,19})(?:\.\d*)?", s)
        bits = 31 if kind.name == "integer" else 63
        if not m or not -(1 << bits) <= int(m[1]) < 1 << bits:
            raise SemanticError(f"'{text}' is no {kind}")
        return int(m[1])
    if kind.name == "numeric":
        m = re.fullmatch(r"([+-]?)(\d*)(?:\.(\d*))?", s)
        if not m or not (m[2] or m[3]):
            raise SemanticError(f"'{text}' is no {kind}")
        fraction, scale = (m[3] or "").rstrip("0"), kind.precision or 0
        if len(fraction) > scale or len(m[2].lstrip("0")) > (kind.length or 18) - scale:
            raise SemanticError(f"'{text}' doesn't fit {kind}")
        return Decimal(f"{m[1]}{m[2] or '0'}.{fraction.ljust(scale, '0')}" if scale else f"{m[1]}{m[2] or '0'}")
    if kind.name == "date":
        return _date(s, text)
    if kind.name == "timestamp":
        m = re.fullmatch(r"(\S+) (\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?", s)
        if not m or int(m[2]) > 23 or int(m[3]) > 59 or int(m[4]) > 59:
            raise SemanticError(f"'{text}' is no timestamp")
        return dt.datetime.combine(_date(m[1], text), dt.time(int(m[2]), int(m[3]), int(m[4]), int(m[5] or 0) * 1000))
    if kind.length is not None and kind.name != "text" and len(s.encode()) > kind.length:
        raise SemanticError(f"type mismatch: '{text}' is longer than {kind}")
    return s


def _date(s: str, text: str) -> dt.date:
    m = re.fullmatch(r"(\d{1,4})-(\d{1,2})-(\d{1,2})", s)
    try:
        return dt.date(*map(int, m.groups()))
    except (AttributeError, ValueError):
        raise SemanticError(f"'{text}' is no date") from None


def show(value, kind: SqlType | None = None) -> str:
    """How a value is printed: numerics with all fraction digits, milliseconds only if there are any."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, dt.datetime):
        ms = value.microsecond // 1000
        return f"{value.year:04}-{value.month:02}-{value.day:02} {value.hour}:{value.minute:02}:{value.second:02}" + (f".{ms:03}" if ms else "")
    if isinstance(value, dt.date):
        return f"{value.year:04}-{value.month:02}-{value.day:02}"
    return str(value)
