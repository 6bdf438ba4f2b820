"""COPY: plain csv (;) and tbl (|) files, without header, quotes or escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import MASTER, Catalog
from ..dml import insert
from ..errors import SemanticError
from ..types import declared
from ..versioning import resolve

SEPARATORS = {"csv": ";", "tbl": "|"}


def separator(kind: str) -> str:
    if kind not in SEPARATORS:
        raise SemanticError(f"unknown format '{kind}'")
    return SEPARATORS[kind]


def read_separated(spark: SparkSession, path: str, schema: T.StructType, kind: str) -> DataFrame:
    """Positional columns, read by the rules of types.parse_literal: a value that its declared
    type can't hold is an error, as it is in INSERT. Nothing between two separators is an
    empty text, and NULL in a nullable column of another type. A separator at the end of a
    line, as TPC-H's generator writes it, is allowed. An empty line is a row of a table
    with one text column, and no row of any other table."""
    raw = spark.read.option("wholetext", False).text(path)
    n = len(schema)
    if n > 1 or not isinstance(schema[0].dataType, T.StringType):
        raw = raw.where(F.col("value") != "")
    parts = F.split("value", f"[{separator(kind)}]", -1)
    size = F.size(parts)
    bad = (size < n) | (size > n + 1) | ((size == n + 1) & (F.element_at(parts, -1) != ""))
    checked = F.when(bad, F.raise_error(F.concat(F.lit(f"{n} columns are expected: "), F.col("value")))).otherwise(parts)
    return raw.select(checked.alias("p")).select([_typed(F.col("p")[i], f).alias(f.name) for i, f in enumerate(schema)])


def _typed(c: Column, field: T.StructField) -> Column:
    kind, s = field.dataType, F.trim(c)

    def if_fits(fits: Column, value: Column) -> Column:
        return F.when(fits, value).otherwise(F.raise_error(F.concat(F.lit(f"{field.name}: no {declared(field)}: "), c)))

    if isinstance(kind, T.StringType):
        length = declared(field).length if declared(field).name != "text" else None
        return c if length is None else if_fits(F.octet_length(c) <= length, c)
    if isinstance(kind, T.BooleanType):
        value = if_fits(s.isin("true", "false"), s == "true")
    elif isinstance(kind, (T.IntegerType, T.LongType)):  # digits after a point are cut off
        number = F.regexp_extract(s, r"^([+-]?\d{1,19})(?:\.\d*)?$", 1).try_cast(kind)
        value = if_fits(number.isNotNull(), number)
    elif isinstance(kind, T.DecimalType):
        pattern = r"^([+-]?)0*(\d*)(?:\.(\d*?)0*)?$"
        whole, fraction = F.regexp_extract(s, pattern, 2), F.regexp_extract(s, pattern, 3)
        fits = s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$") & (F.length(whole) <= kind.precision - kind.scale) & (F.length(fraction) <= kind.scale)
        value = if_fits(fits, s.try_cast(kind))
    elif isinstance(kind, T.DateType):
        value = if_fits(s.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$"), _day(s))
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):  # the fraction counts milliseconds
        pattern = r"^(\S+) (\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?$"
        part = [F.regexp_extract(s, pattern, k) for k in range(1, 6)]
        text = F.concat(part[0], F.lit(" "), *[x for k in (1, 2, 3) for x in (F.lpad(part[k], 2, "0"), F.lit(":" if k < 3 else "."))], F.lpad(part[4], 3, "0"))
        value = if_fits(s.rlike(pattern) & text.try_cast(kind).isNotNull(), text.try_cast(kind))
    else:
        value = s.cast(kind)
    return F.when(s != "", value) if field.nullable else value


def _day(s: Column) -> Column:
    year, month, day = (F.split_part(s, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))
    return F.make_date(year, month, day)


def copy_from(catalog: Catalog, name: str, path: str, kind: str) -> None:
    """All rows of the file into master."""
    insert(catalog, name, read_separated(catalog.spark, path, catalog.table(name).schema, kind), MASTER)


def copy_to(catalog: Catalog, name: str, path: str, kind: str, branch: str = MASTER) -> None:
    """The rows that the branch sees, in place of what the path held; one file for each task."""
    write_separated(resolve(catalog, name, branch), path, kind)


def write_separated(df: DataFrame, path: str, kind: str) -> None:
    sep = separator(kind)
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    clash = F.lit(False)
    for c, (_, t) in zip(texts, df.dtypes):
        if t == "string":
            clash = clash | c.contains(sep) | c.contains("\n")
    line = F.concat_ws(sep, *texts)
    df.select(F.when(clash, F.raise_error(F.concat(F.lit("a value holds a separator: "), line))).otherwise(line).alias("value")).write.mode("overwrite").text(path)
