"""Money and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"


def amount(c: Column) -> Column:
    return c.cast(MONEY)


def half_even(c: Column) -> Column:
    return F.bround(c, 2)


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5), which differs from round() for negative halves."""
    return F.floor(c + F.lit(0.5))


def ratio(a: Column, b: Column, scale: int) -> Column:
    """a / b of non-negative amounts, rounded half up to ``scale`` digits; null if b is 0."""
    unit = 10.0**scale
    return F.floor(a.cast("double") * unit / F.nullif(b.cast("double"), F.lit(0.0)) + 0.5) / unit


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def backoff_minutes(attempts: Column) -> Column:
    """2 ** min(attempts, 30)."""
    return F.pow(F.lit(2.0), F.least(attempts, F.lit(30))).cast("long")
