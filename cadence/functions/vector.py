"""Vectors as ``ARRAY`` columns, by higher-order functions that stay in the JVM. Sums are of doubles, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column, eps: float = 1e-8) -> Column:
    """``a / (|a| + eps)``."""
    a = _col(a)
    size = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / size)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def weighted_merge(a: str | Column, na: Column, b: str | Column, nb: Column) -> Column:
    """Mean of two centroids by their counts, brought to length 1."""
    return unit(F.zip_with(_col(a), _col(b), lambda x, y: (na * x.cast("double") + nb * y.cast("double")) / (na + nb)))


def tail(a: str | Column, n: int) -> Column:
    a = _col(a)
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - F.lit(n - 1)), F.lit(n))
