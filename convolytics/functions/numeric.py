"""Rates, shares and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_divide(num: Column, den: Column) -> Column:
    """Double division that yields null instead of failing on a zero divisor
    (ANSI mode raises even for doubles)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rate(condition: Column) -> Column:
    """F6 aggregate: rows where ``condition`` is true / all rows x 100.

    Rows where the condition is null (a null label) are not counted in the
    numerator but stay in the denominator. Divide first, then multiply.
    """
    return safe_divide(F.count(F.when(condition, F.lit(1))), F.count(F.lit(1))) * F.lit(100.0).cast("double")


def share(n: Column, total: Column) -> Column:
    """``n / total x 100`` as a double; null when total is 0."""
    return safe_divide(n, total) * F.lit(100.0).cast("double")


def round2(x: Column) -> Column:
    """round to two places, half to even on the scaled double
    (the same as numpy's ``round(x, 2)``)."""
    return F.rint(x * F.lit(100.0).cast("double")) / F.lit(100.0).cast("double")
