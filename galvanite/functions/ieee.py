"""Division and logarithm at zero as floating-point numbers have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b of doubles: infinite for b = 0, NaN for 0 / 0, null only for null."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def log10(x: Column) -> Column:
    """log10 of a double, minus infinity at zero; null for negative values."""
    return F.when(x == 0, float("-inf")).otherwise(F.log10(x))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < float("inf"), x)
