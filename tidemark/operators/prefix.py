"""Running values over a key of any length: each task sorts one bucket of it, and what came before arrives as one row.

Sums and last known values are associative, so a bucket's running value is what the earlier buckets add up to, together with its
own rows so far. The row per bucket is made by an aggregate and carried forward over buckets, never over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that one carrying task sees of a key of unbounded extent: with more, buckets of buckets are carried first.
FAN = 1024


def carried(df: DataFrame, keys: list[str], bucket: Column | None, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, before_sums: dict[str, Column] | None = None, befores: dict[str, Column] | None = None, before_maxes: dict[str, Column] | None = None, afters: dict[str, Column] | None = None) -> DataFrame:
    """df with running columns over keys in the order of `order`: sums, maxes, and lasts, the latest value that is not null;
    before_sums, before_maxes and befores are the same without the row itself; afters are the values (none of them null) of the next row.

    bucket, whole numbers, must not fall as order rises (a part of the time, say); without one, a task sorts a whole key. Without keys, buckets are
    carried by FAN. Rows equal in order may come either way round: give an order without ties. Null sums count 0.
    """
    adds, latest, most, nexts = {**(sums or {}), **(before_sums or {})}, {**(lasts or {}), **(befores or {})}, {**(maxes or {}), **(before_maxes or {})}, afters or {}
    late = {*(before_sums or {}), *(befores or {}), *(before_maxes or {})}
    within = [] if bucket is None else ["_bucket"]
    rows = df if bucket is None else df.withColumn("_bucket", bucket)
    span = Window.partitionBy(*keys, *within).orderBy(*order)
    over = lambda n: span.rowsBetween(Window.unboundedPreceding, -1 if n in late else 0)
    own = {n: F.coalesce(F.sum(c).over(over(n)), F.lit(0)) for n, c in adds.items()} | {n: F.last(c, ignorenulls=True).over(over(n)) for n, c in latest.items()}
    own |= {n: F.max(c).over(over(n)) for n, c in most.items()} | {n: F.lead(c).over(span) for n, c in nexts.items()}
    if bucket is None:
        return rows.withColumns(own)
    place = F.struct(*order)
    totals = rows.groupBy(*keys, "_bucket").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_c_{n}") for n, c in adds.items()),
        *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_c_{n}") for n, c in latest.items()),
        *(F.max(c).alias(f"_c_{n}") for n, c in most.items()),
        *(F.min_by(c, place).alias(f"_c_{n}") for n, c in nexts.items()),
    )
    held = lambda names: {f"_b_{n}": F.col(f"_c_{n}") for n in names}
    totals, up = totals.withColumnRenamed("_bucket", "_at"), None
    if not keys:
        totals, up = totals.withColumn("_whole", F.lit(0)), F.floor(F.col("_at") / FAN)
    carry = carried(totals, keys or ["_whole"], up, ["_at"], before_sums=held(adds), befores=held(latest), before_maxes=held(most), afters=held(nexts))
    # What is carried into a bucket comes as a row before its rows, what follows the bucket as a row behind them: rows are shuffled once, for the window.
    as_row = lambda side, names: carry.select(*keys, F.col("_at").alias("_bucket"), F.lit(side).alias("_side"), *(F.col(f"_b_{n}").alias(f"_v_{n}") for n in names))
    values = {**adds, **latest, **most, **nexts}
    every = rows.withColumns({f"_v_{n}": c for n, c in values.items()}).withColumn("_side", F.lit(1))
    if adds or latest or most:
        every = every.unionByName(as_row(0, [*adds, *latest, *most]), allowMissingColumns=True)
    if nexts:
        every = every.unionByName(as_row(2, nexts).dropna(subset=[f"_v_{n}" for n in nexts]), allowMissingColumns=True)
    span = Window.partitionBy(*keys, "_bucket").orderBy("_side", *order)
    found = {n: F.coalesce(F.sum(f"_v_{n}").over(over(n)), F.lit(0)) for n in adds} | {n: F.last(f"_v_{n}", ignorenulls=True).over(over(n)) for n in latest}
    found |= {n: F.max(f"_v_{n}").over(over(n)) for n in most} | {n: F.lead(f"_v_{n}").over(span) for n in nexts}
    return every.select(*df.columns, "_side", *(c.alias(f"_found_{n}") for n, c in found.items())).filter("_side = 1").select(*(c for c in df.columns if c not in found), *(F.col(f"_found_{n}").alias(n) for n in found))
