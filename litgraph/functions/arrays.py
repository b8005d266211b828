"""Vectors, weights and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; null where both are zero."""
    part = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.try_divide(part(lambda x, y: F.least(x, y)), part(lambda x, y: F.greatest(x, y)))


def set_jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def padded(items: Column, n: int, fill) -> Column:
    """Cut or filled to n items."""
    return F.slice(F.concat(items, F.array_repeat(F.lit(fill), n)), 1, n)


def shifted(items: Column) -> tuple[Column, Column]:
    """Inputs without the last item, targets without the first."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.slice(items, 1, n), F.slice(items, 2, n)


def positional_encoding(position: Column, dimensions: int) -> Column:
    """Sines and cosines of falling frequency."""
    return F.array(*(f(position / F.lit(10_000.0 ** (2 * (i // 2) / dimensions))) for i in range(dimensions) for f in [F.sin if i % 2 == 0 else F.cos]))
