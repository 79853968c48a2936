"""Vector distance on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_distance(left: Column, right: Column) -> Column:
    return 1.0 - _dot(left, right) / (F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right)))
