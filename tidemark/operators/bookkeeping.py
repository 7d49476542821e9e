"""Job and label tables: latest versions, upserts, paging, samples, progress and first-match rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key by order, as rank 1..n."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with each key's newest change in its place, and new keys added; changes win equal versions."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return newest(both, keys, [F.col(version).desc(), F.col("_new").desc()]).drop("rank", "_new")


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def evenly_picked(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Of each key, n rows at even steps from first to last; all rows where there are no more."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    place = F.floor(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    before = F.floor((F.col("_i") - 1) * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return rows.filter((F.col("_n") <= n) | (F.col("_i") == 0) | (place > before)).drop("_i", "_n")


def progress(df: DataFrame, keys: list[str], order: list[str], percent: str, keep: int) -> DataFrame:
    """percent as its running maximum, of the last `keep` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("shown", F.max(percent).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= keep).drop("_back")


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (pattern, name) that text matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
