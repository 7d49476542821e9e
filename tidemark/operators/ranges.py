"""Band, interval-overlap and as-of joins.

Spark has no range join, and a join on inequalities alone compares all pairs. Here the time axis is cut
into buckets, the side with extent is put into every bucket that it touches, and the join is an equality
of key and bucket with the exact condition on top. Each result pair is found in one bucket only: the one
in which its overlap begins. Rows per bucket stay bounded when the width is near the usual extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join in which both sides grow with the input: both are shuffled by key, none is sent through the driver. Spark would take
    the size of compressed files, or of a few columns of them, for that of the rows in memory, which can be a hundred times as large."""
    return df.hint("merge")


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / width)


def _spread(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    whole = df.filter(start <= end)
    return whole.withColumn("_bucket", F.explode(F.sequence(_bucket(start, width), _bucket(end, width))))


def band_pairs(points: DataFrame, bands: DataFrame, keys: list[str], time: str, low: Column, high: Column, width: float, open_low: bool = False) -> DataFrame:
    """Every pair of a point and a band low..high (columns of bands) of the same keys that holds its time.
    Both ends belong to the band, the lower one not if open_low. Other columns must not clash."""
    wide = _spread(bands.withColumns({"_low": low, "_high": high}), F.col("_low"), F.col("_high"), width)
    inside = (F.col(time) > F.col("_low")) if open_low else (F.col(time) >= F.col("_low"))
    pairs = points.withColumn("_bucket", _bucket(F.col(time), width)).join(by_key(wide), [*keys, "_bucket"])
    return pairs.filter(inside & (F.col(time) <= F.col("_high"))).drop("_bucket", "_low", "_high")


def band_totals(points: DataFrame, bands: DataFrame, keys: list[str], time: str, low: int, high: int, width: int, sums: dict[str, Column] | None = None, first: str | None = None) -> DataFrame:
    """Each band of bands, time + low..time + high with both ends, that holds a point of the same keys: bands' columns, n (points in it), sums (of columns of
    points, null where all are) and _first, time and `first` of the earliest of them (the smaller `first` of those at one time). Times and summed columns are whole numbers.

    No pair is made: totals are differences of running ones, so the work grows with points and bands, however many points a band holds. A task sorts one
    bucket of a key, width long, with the points that the bands of the bucket can reach.
    """
    sums = sums or {}
    known = F.col(time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    own = bands.columns
    at = F.col(time)
    seen = points.filter(known).select(*keys, at.alias("_t"), F.lit(1).cast("long").alias("_n"), F.struct(at.alias("t"), F.col(first or time).alias("v")).alias("_first"), *(c.alias(f"_s_{n}") for n, c in sums.items()))
    seen = seen.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_t") - high, width), _bucket(F.col("_t") - low, width))))
    rows = bands.filter(known).withColumns({"_t": at, "_bucket": _bucket(at, width), "_band": F.lit(True)}).unionByName(seen, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_bucket")
    # Frames that begin with the partition only grow: up to the upper end, back to the lower end, and all of it. What both of the first hold is counted twice.
    upto, back = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, high), part.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, -low)
    of = lambda f, c, over: F.coalesce(f(c).over(over), F.lit(0))
    inner = lambda f, c: of(f, c, upto) + of(f, c, back) - of(f, c, part)
    found = {"n": inner(F.count, "_n"), "_first": F.min("_first").over(back)} | {x: F.when(inner(F.count, f"_s_{x}") > 0, inner(F.sum, f"_s_{x}")) for x in sums}
    rows = rows.select(*own, "_band", *(c.alias(f"_found_{x}") for x, c in found.items())).filter(F.col("_band") & (F.col("_found_n") > 0))
    return rows.select(*own, *(F.col(f"_found_{x}").alias(x) for x in found))


def band_semi(rows: DataFrame, row_id: str, points: DataFrame, keys: list[str], time: str, low: Column, high: Column, width: float, open_low: bool = False, anti: bool = False) -> DataFrame:
    """The rows with a point in their band (without one if anti), whole and once each."""
    found = band_pairs(points.select(*keys, time), rows.select(*keys, F.col(row_id), low.alias("_l"), high.alias("_h")), keys, time, F.col("_l"), F.col("_h"), width, open_low)
    return rows.join(found.select(row_id).distinct(), row_id, "left_anti" if anti else "left_semi")


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], width: float, strict: bool = False) -> DataFrame:
    """Every pair of intervals (a_start, a_end) and (b_start, b_end) of the same keys that touch, or share
    more than a point if strict."""
    left, right = _spread(a, F.col("a_start"), F.col("a_end"), width), _spread(b, F.col("b_start"), F.col("b_end"), width)
    begin = F.greatest("a_start", "b_start")
    meet = F.least("a_end", "b_end")
    pairs = left.join(by_key(right), [*keys, "_bucket"]).filter(_bucket(begin, width) == F.col("_bucket"))
    return pairs.filter(begin < meet if strict else begin <= meet).drop("_bucket")


def asof(probes: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Each probe with the last sample at or before it (prev_time, prev_value) and the first at or after it
    (next_time, next_value), null where there is none. Of samples at one time the greatest value counts.

    Windows run within buckets of time, and what reaches into a bucket from outside is carried over from
    one row a bucket, so a key with very many rows is spread over many tasks. Probe columns are kept.
    """
    columns = probes.columns
    one = samples.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, time).agg(F.max(value).alias("_v"))
    both = probes.filter(F.col(time).isNotNull()).withColumns({"_v": F.lit(None).cast(samples.schema[value].dataType), "_probe": F.lit(True)}).unionByName(one.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_s", F.when(~F.col("_probe"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))).withColumn("_bucket", _bucket(F.col(time), width))
    w = Window.partitionBy(*keys, "_bucket").orderBy(time)
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"_p": F.max("_s").over(before), "_n": F.min("_s").over(after)}).filter("_probe")
    ends = one.withColumn("_bucket", _bucket(F.col(time), width)).groupBy(*keys, "_bucket").agg(F.min(F.struct(F.col(time).alias("t"), F.col("_v").alias("v"))).alias("_first"), F.max(F.struct(F.col(time).alias("t"), F.col("_v").alias("v"))).alias("_last"))
    spots = both.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    b = Window.partitionBy(*keys).orderBy("_bucket")
    spots = spots.select(*keys, "_bucket", F.max("_last").over(b.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"), F.min("_first").over(b.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"))
    out = near.join(spots, [*keys, "_bucket"], "left").withColumns({"_p": F.coalesce("_p", "_cp"), "_n": F.coalesce("_n", "_cn")})
    return out.select(*columns, F.col("_p.t").alias("prev_time"), F.col("_p.v").alias("prev_value"), F.col("_n.t").alias("next_time"), F.col("_n.v").alias("next_value"))


def interpolated(df: DataFrame, time: str, tolerance: float) -> DataFrame:
    """After asof: value, and how it was found. Exact hits first, then a linear blend of two samples within
    tolerance, then the only one within it; null (`none`) beyond. An equal distance prefers the earlier one."""
    back, ahead = F.col(time) - F.col("prev_time"), F.col("next_time") - F.col(time)
    left, right = F.coalesce(back <= tolerance, F.lit(False)), F.coalesce(ahead <= tolerance, F.lit(False))
    part = back / (back + ahead)
    blend = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * part
    value = F.when(back == 0, F.col("prev_value")).when(left & right, blend).when(left, F.col("prev_value")).when(right, F.col("next_value"))
    how = F.when(back == 0, "exact").when(left & right, "blend").when(left, "prev").when(right, "next").otherwise("none")
    nearest = F.when(left & (~right | (back <= ahead)), F.col("prev_time")).when(right, F.col("next_time"))
    return df.withColumns({"value_at": value.cast("double"), "how": how, "nearest_time": nearest})
