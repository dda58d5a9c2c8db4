"""Guarded arithmetic and exact number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; NULL unless ``whole`` is positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def whole_quotient(part: Column, whole: Column) -> Column:
    """Truncating quotient, 0 when ``whole`` is not positive."""
    safe = F.when(whole > 0, whole).otherwise(F.lit(1))
    return F.when(whole > 0, F.call_function("div", part, safe)).otherwise(F.lit(0)).cast("bigint")


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above a non-negative ``value``."""
    return F.call_function("div", value, F.lit(step)) * step


def ceil_to(value: Column, step: int) -> Column:
    """Smallest multiple of ``step`` not below a non-negative ``value``."""
    return floor_to(value + (step - 1), step)


def saturating_minus(left: Column, right: Column) -> Column:
    return F.greatest(left - right, F.lit(0).cast("bigint"))


def text_0(value: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.rint(value).cast("bigint").cast("string")


def text_1(value: Column) -> Column:
    """Round a non-negative double to one decimal, by its exact binary value.

    A value sits on a rounding boundary when 20x is an odd integer. 16x and 4x
    are exact, so their sum plus its rounding error is exactly 20x; the sign of
    the error says on which side of the boundary x lies, and 0 is a true tie.
    """
    a, b = value * 16.0, value * 4.0
    total = a + b
    carried = total - a
    error = (a - (total - carried)) + (b - carried)
    doubled = F.floor(total)
    on_boundary = (total == doubled.cast("double")) & (doubled % 2 == 1)
    lower = F.call_function("div", doubled, F.lit(2))
    tenths = (
        F.when(~on_boundary, F.call_function("div", doubled + 1, F.lit(2)))
        .when(error > 0, lower + 1)
        .when(error < 0, lower)
        .otherwise(lower + lower % 2)
    )
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))
