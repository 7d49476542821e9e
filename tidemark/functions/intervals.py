"""Column expressions over closed intervals [start, end]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection, 0 where there is none."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0).cast("double"))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of both intervals; 0 for an empty hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def touches(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)
