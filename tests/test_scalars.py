"""Values, casts and arithmetic."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from forkline.errors import SemanticError
from forkline.functions import numeric as N
from forkline.types import SqlType, parse_literal, show, sql_type


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_arithmetic(spark):
    i = lambda n: F.lit(n)
    assert [one(spark, x) for x in (i(6) + i(7), i(6) - i(7), i(6) * i(7), N.int_div(i(5), i(2)), N.int_div(i(-5), i(2)))] == [13, -1, 42, 2, -2]
    d = lambda t, k="decimal(18,2)": F.lit(Decimal(t)).cast(k)
    assert one(spark, d("6") * d("7")) == 42
    assert one(spark, N.numeric_div(d("5"), d("2"), 2, 2)) == Decimal("2.50")
    assert one(spark, N.numeric_div(d("5.0000", "decimal(18,4)"), d("2"), 4, 2)) == Decimal("2.5000")
    assert [one(spark, N.numeric_to_int(d(t))) for t in ("2.99", "-2.99")] == [2, -2]
    assert [one(spark, N.trunc_decimal(d(t), 1)) for t in ("2.99", "-2.99", "0.00")] == [Decimal("2.9"), Decimal("-2.9"), Decimal("0.0")]
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        one(spark, F.lit(2_005_000_000) + F.lit(2_005_000_000))
    with pytest.raises(Exception, match="ZERO"):
        one(spark, N.int_div(F.lit(1), F.lit(0)))
    assert one(spark, N.trunc_decimal(F.lit(None).cast("decimal(18,2)"), 1)) is None


@pytest.mark.parametrize(
    "text, kind, value",
    [
        (" 12.7 ", "integer", 12), ("-5", "integer", -5), ("9999999999", "longinteger", 9999999999), ("true", "bool", True),
        ("4", SqlType("numeric", 32, 8), Decimal("4.00000000")), ("-1.500", SqlType("numeric", 4, 1), Decimal("-1.5")),
        ("2020-02-29", "date", dt.date(2020, 2, 29)), ("2020-1-2 3:04:05.5", "timestamp", dt.datetime(2020, 1, 2, 3, 4, 5, 5000)), ("abc", SqlType("char", 3), "abc"), ("", "text", ""),
    ],
)
def test_literals(text, kind, value):
    assert parse_literal(text, kind if isinstance(kind, SqlType) else SqlType(kind)) == value


@pytest.mark.parametrize("text, kind", [("x", "integer"), ("9999999999", "integer"), ("True", "bool"), ("1.25", SqlType("numeric", 4, 1)), ("12345", SqlType("numeric", 4, 1)), ("2021-02-29", "date"), ("2021-02-28", "timestamp"), ("abcd", SqlType("varchar", 3))])
def test_bad_literals(text, kind):
    with pytest.raises(SemanticError):
        parse_literal(text, kind if isinstance(kind, SqlType) else SqlType(kind))


def test_types_and_printing():
    assert sql_type("NUMERIC", (32, 8)).spark().simpleString() == "decimal(32,8)"
    assert sql_type("int").spark().simpleString() == "int" and sql_type("TIMESTAMP").spark().simpleString() == "timestamp_ntz"
    assert [show(x) for x in (None, True, Decimal("1.50"), dt.date(5, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2, 3, 4, 5, 6000))] == ["NULL", "true", "1.50", "0005-01-02", "2020-01-02 3:04:05", "2020-01-02 3:04:05.006"]
