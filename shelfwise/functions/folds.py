"""Ordered folds over small arrays, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decayed_stat(ordered: Column, alpha: float = 0.2, presorted: bool = False) -> Column:
    """Exponentially decayed mean and variance of an array of struct<ord, v>.

    The array is sorted by `ord` unless it is `presorted`; callers bound its length by the calendar (one entry per
    closed day, or per closed hour of a day).
    """
    start = F.struct(
        F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"), F.lit(0).cast("long").alias("n")
    )

    def observe(state: Column, item: Column) -> Column:
        value = item["v"].cast("double")
        delta = value - state["mean"]
        first = state["n"] == 0
        mean = F.when(first, value).otherwise(state["mean"] + alpha * delta)
        variance = F.when(first, F.lit(0.0)).otherwise(
            (1.0 - alpha) * (state["variance"] + alpha * delta * delta)
        )
        return F.struct(mean.alias("mean"), variance.alias("variance"), (state["n"] + 1).alias("n"))

    return F.aggregate(ordered if presorted else F.array_sort(ordered), start, observe)


def stddev_of(stat: Column) -> Column:
    return F.sqrt(F.greatest(stat["variance"], F.lit(0.0)))


# Fixed value: weight of a new observation of the recent-rate average.
NEW_WEIGHT = 0.35


def recent_rate_step(previous: Column, rate: Column) -> Column:
    """One observation of the recent-rate average; a stored zero counts as 'no value yet'."""
    return F.when(previous == 0.0, rate).otherwise(NEW_WEIGHT * rate + (1.0 - NEW_WEIGHT) * previous)
