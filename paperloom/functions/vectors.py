"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def softmax_within(score: Column, *keys: str) -> Column:
    """Share of exp(score) within the rows of a key, shifted by the largest."""
    w = Window.partitionBy(*keys)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)
