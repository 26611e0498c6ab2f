"""Column expressions over vectors, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A constant vector, folded into the plan."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different size, NaN for a zero vector, null for null."""
    length = norm(a) * norm(b)
    value = F.when(length == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), length))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null for vectors of different size."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
