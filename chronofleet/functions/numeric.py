"""Finite-value and rounding helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807
LONG_MIN = -9223372036854775808


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(c: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def saturating_add(a: Column, b: Column) -> Column:
    """64-bit addition that stops at the ends of the range."""
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.when(b > 0, LONG_MAX).otherwise(LONG_MIN)))


def saturating_multiply(a: Column, factor: int) -> Column:
    """64-bit multiplication by a positive constant that stops at the ends of the range."""
    ends = F.when(a > 0, LONG_MAX).when(a < 0, LONG_MIN)
    return F.coalesce(F.try_multiply(a, F.lit(factor).cast("bigint")), ends)


def double_to_long(c: Column) -> Column:
    """Round half away from zero to BIGINT; saturates, NaN becomes 0, NULL stays NULL."""
    return (
        F.when(F.isnan(c), F.lit(0).cast("bigint"))
        .when(c >= F.lit(float(2**63)), F.lit(LONG_MAX))
        .when(c <= F.lit(-float(2**63)), F.lit(LONG_MIN))
        .otherwise(F.round(c).try_cast("bigint"))
    )


def int_div(c: Column, n: int) -> Column:
    """Integer division truncating toward zero."""
    return F.call_function("div", c, F.lit(n).cast("bigint"))


def round_half_up(c: Column) -> Column:
    """Nearest integer with ties toward positive infinity."""
    return F.floor(c + 0.5)
