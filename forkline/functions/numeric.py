"""Scalar arithmetic and casts, as built-in expressions that stay in generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_decimal(c: Column, scale: int, precision: int = 38) -> Column:
    """Cast to a numeric of fewer fraction digits, cutting the rest off toward zero."""
    at = F.lit(scale)
    return F.when(c < 0, F.ceil(c, at)).otherwise(F.floor(c, at)).cast(f"decimal({precision},{scale})")


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, cut off toward zero; a zero divisor is an error."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def cut_quotient(a: Column, b: Column, scale: int) -> Column:
    """a / b with `scale` fraction digits, cut off exactly: both are whole numbers here, and
    the remainder is taken away before the division, so that nothing is ever rounded."""
    whole = (a * F.lit(Decimal(10) ** scale)).cast("decimal(38,0)")
    units = ((whole - whole % b) / b).cast(f"decimal({36 - scale},0)")
    return units if not scale else units * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")


def numeric_div(a: Column, b: Column, scale_a: int, scale_b: int) -> Column:
    """Quotient of two numerics with the larger of their scales, cut off; a zero divisor is an error."""
    shift = F.lit(Decimal(10) ** scale_b)
    over, under = a.cast(f"decimal(19,{scale_a})") * shift, (b.cast(f"decimal(19,{scale_b})") * shift).cast("decimal(19,0)")
    return cut_quotient(over, under, max(scale_a, scale_b))


def average(c: Column, scale: int) -> Column:
    """The average of the values that aren't null, cut off at `scale` fraction digits (no more
    than `scale` of which the values have); null if there are none."""
    return F.when(F.count(c) > 0, cut_quotient(F.sum(c.cast(f"decimal(24,{scale})")), F.greatest(F.count(c), F.lit(1)).cast("decimal(19,0)"), scale)).cast(f"decimal(18,{scale})")


def int_to_numeric(c: Column, precision: int = 18, scale: int = 4) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def numeric_to_int(c: Column) -> Column:
    """The part before the point, toward zero."""
    return trunc_decimal(c, 0).cast("int")


def log_bucket(discount: Column, value: Column) -> Column:
    """floor(log2((discount + 1) * value))."""
    return F.floor(F.log2((discount.cast("double") + F.lit(1.0)) * value.cast("double"))).cast("long")


def strict_null_sum(c: Column) -> Column:
    """A sum that is null as soon as one input is; the standard sum leaves nulls out."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def polynomial(x: Column, coefficients) -> Column:
    """Horner's scheme, the highest coefficient first."""
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total
