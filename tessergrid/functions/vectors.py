"""Vector algebra as column expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Scaled to length 1; null for zero vectors and those with parts that are not finite."""
    length = norm(v)
    return F.when((length > 0) & (length < float("inf")) & ~F.isnan(length), F.transform(v, lambda x: x / length))
