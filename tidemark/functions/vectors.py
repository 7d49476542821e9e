"""Column expressions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    """The vector at unit length; one of length next to 0 stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > TINY, x / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is degenerate."""
    size = norm(a) * norm(b)
    return F.when(size > TINY, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine clipped to [-1, 1]."""
    return 1 - F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))
