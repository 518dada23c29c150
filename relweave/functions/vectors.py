"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE>; sums in double, in the order of the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zero or their lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def unit(a: Column) -> Column:
    """Divided by its norm, or by 1e-12 if that is larger."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(FLOOR)))


def first_dims(a: Column, dims: int | Column) -> Column:
    return F.slice(a, F.lit(1), F.lit(dims) if isinstance(dims, int) else dims)


def common_dims(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def non_negative(x: Column) -> Column:
    """0 for NaN and negative values."""
    return F.when(F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x)


def rank_discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)
