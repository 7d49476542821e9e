"""Gaps and islands: sessions, coalesced intervals, state runs, padding and layout of intervals.

All of these reduce to LAG/LEAD, running maxima and running sums within a key, so each is one shuffle.
Where a key has very many rows, or there is none, a task sorts one bucket of the time only, and running values are carried
from bucket to bucket (`prefix.carried`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import carried


def _running(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def sessions(df: DataFrame, keys: list[str], time: str, gap: float, tie: str, best: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Rows of each key grouped while the step in time is at most gap: keys, session, start, end, n, and
    top, the tie column of the row with the greatest `best` (earliest wins ties). bucket: a part of the time that one task sorts, for keys with
    very many rows (see prefix.carried)."""
    held = df if bucket is None else df.withColumn("_part", bucket)
    at = None if bucket is None else F.col("_part")
    rows = carried(held, keys, at, [time, tie], befores={"_before": F.col(time)})
    rows = carried(rows.withColumn("_new", F.coalesce((F.col(time) - F.col("_before") > gap).cast("long"), F.lit(1))), keys, at, [time, tie], sums={"session": F.col("_new")})
    aggs = [F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")]
    if best:
        aggs.append(F.max_by(tie, F.struct(F.col(best), -F.col(time), -F.col(tie))).alias("top"))
    return rows.groupBy(*keys, "session").agg(*aggs)


def coalesce_intervals(df: DataFrame, keys: list[str], slack: float = 0, min_length: float | None = None, weight: str | None = None, width: float | None = None) -> DataFrame:
    """Union of intervals start, end within each key; those at most slack apart become one. Intervals that
    end before they start are dropped, and at last those of min_length or less. weight is summed. width: the part of the time that one
    task sorts, for keys with very many intervals, or for none at all (see prefix.carried)."""
    rows = df.filter(F.col("end") >= F.col("start"))
    at = None if width is None else F.floor(F.col("start") / width)
    order = ["start", "end"]
    rows = carried(rows, keys, at, order, before_maxes={"_before": F.col("end")})
    rows = carried(rows.withColumn("_new", F.coalesce((F.col("start") > F.col("_before") + slack).cast("int"), F.lit(1))), keys, at, order, sums={"_island": F.col("_new")})
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"), *([F.sum(weight).alias(weight)] if weight else [])]
    out = rows.groupBy(*keys, "_island").agg(*aggs).drop("_island")
    return out if min_length is None else out.filter(F.col("end") - F.col("start") > min_length)


def coalesce_globally(df: DataFrame, width: float, weight: str | None = None) -> DataFrame:
    """coalesce_intervals without a key: a task sorts the intervals that start in one bucket, and the reach of earlier buckets is carried to it."""
    return coalesce_intervals(df, [], weight=weight, width=width)


def union_length(df: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """Time covered by the intervals of each key; width as in coalesce_intervals."""
    return coalesce_intervals(df.filter("end > start"), keys, width=width).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def state_runs(df: DataFrame, keys: list[str], time: str, state: str, tie: str) -> DataFrame:
    """Runs of equal state: keys, run, state, start, end, n and first, the tie column of the first row."""
    w = _running(keys, time, tie)
    new = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(time).over(w).isNull()).cast("int")
    rows = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.min_by(tie, F.struct(time, tie)).alias("first"))


def alternating_runs(df: DataFrame, keys: list[str], time: str, side: str, tie: str, gap: float, least: int = 3) -> DataFrame:
    """Runs in which the side changes with every row and no step exceeds gap, of at least `least` rows.
    Rows without a side are left out first and do not break a run."""
    w = _running(keys, time, tie)
    step = F.col(time) - F.lag(time).over(w)
    new = F.coalesce(((step > gap) | (F.lag(side).over(w) == F.col(side))).cast("int"), F.lit(1))
    rows = df.filter(F.col(side).isNotNull()).withColumn("_new", new)
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.min_by(side, F.struct(time, tie)).alias("first_side"))
    return out.filter(F.col("n") >= least)


def padded(df: DataFrame, keys: list[str], pre: float, post: float, limit: str, width: float | None = None) -> DataFrame:
    """Intervals widened by pre and post within [0, limit]. Where the paddings of neighbours collide, their gap
    is split in proportion to post and pre; neighbours that overlap before padding keep their own ends there. width: the part of the time that one task sorts."""
    at = None if width is None else F.floor(F.col("start") / width)
    rows = carried(df, keys, at, ["start", "end"], befores={"_left": F.col("end")}, afters={"_right": F.col("start")})
    left, right = F.col("_left"), F.col("_right")
    share = post / (pre + post) if pre + post else 0.0
    start, end = F.greatest(F.col("start") - pre, F.lit(0).cast("double")), F.least(F.col("end") + post, F.col(limit))
    # The boundary between an interval and the next one, where their paddings meet.
    cut = lambda e, s: e + (s - e) * share
    meets = lambda e, s: e + post > s - pre
    new_start = F.when(left.isNotNull() & meets(left, F.col("start")), F.when(F.col("start") >= left, cut(left, F.col("start"))).otherwise(F.col("start"))).otherwise(start)
    new_end = F.when(right.isNotNull() & meets(F.col("end"), right), F.when(right >= F.col("end"), cut(F.col("end"), right)).otherwise(F.col("end"))).otherwise(end)
    return rows.withColumns({"padded_start": new_start, "padded_end": new_end}).drop("_left", "_right")


def layout(df: DataFrame, keys: list[str], gap: float, width: float | None = None) -> DataFrame:
    """Where each interval lands when all are put in a row with gap between: idx, out_start, out_end, and
    pause, the time to the next one (null for the last). width: the part of the time that one task sorts."""
    at = None if width is None else F.floor(F.col("start") / width)
    length = F.col("end") - F.col("start")
    rows = carried(df, keys, at, ["start", "end"], before_sums={"idx": F.lit(1).cast("long"), "out_start": (length + gap).cast("double")}, afters={"_next": F.col("start")})
    pause = F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next") - F.col("end"), F.lit(0).cast("double")))
    return rows.withColumns({"idx": F.col("idx").cast("int"), "out_end": F.col("out_start") + length, "pause": pause}).drop("_next")
