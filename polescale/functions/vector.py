"""Vector arithmetic on ``array<float|double>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(x: Column, tau: Column) -> Column:
    """Of an array: shifted by its maximum, so that no exponential overflows."""
    z = F.transform(x, lambda v: F.exp((v - F.array_max(x)) / tau))
    total = F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    return F.transform(z, lambda v: v / total)
