"""Saturating casts, clamps and order-independent means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT_MIN, _INT_MAX = -2147483648, 2147483647


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    # greatest and least skip nulls; a null value stays null.
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def trunc_int(value: Column) -> Column:
    """Truncate toward zero into a 32-bit integer, saturating at its ends."""
    return clamp(value, float(_INT_MIN), float(_INT_MAX)).cast("int")


def exact_mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count).otherwise(F.lit(0.0))
