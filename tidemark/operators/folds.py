"""Operators whose next decision depends on the last: greedy suppression, automata and scans.

Suppression folds short chains, cut where a decision cannot reach. The automaton and the scan need no fold: what closes a bout, and
which row is next in turn, follow from running values alone, which prefix.carried computes bucket by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.islands import _running
from tidemark.operators.prefix import carried
from tidemark.operators.ranges import by_key
from tidemark.sources.scratch import written


def suppressed(df: DataFrame, keys: list[str], time: str, score: str, tie: str, radius: float, limit: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression: by score (then the smaller tie), a row is kept unless a kept one of its
    key is nearer than radius. With limit, at most so many best rows of a key are kept.

    Rows at least radius apart with nothing between cannot suppress each other, so every chain of nearer
    rows is folded on its own; the limit then ranks what the chains keep.
    """
    w = _running(keys, time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) >= radius).cast("int"), F.lit(1))
    rows = df.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("k"), F.col(time).alias("t"))
    whole = rows.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    start = F.slice("_all", 1, 0)
    fold = F.aggregate("_all", start, lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(y["t"] - x["t"]) < radius), kept).otherwise(F.array_append(kept, x)))
    kept = whole.select(*keys, F.explode(fold).alias("_x")).select(*keys, F.col("_x.k").alias(tie), F.col("_x.t").alias(time), (-F.col("_x.s")).alias(score))
    if limit is None:
        return kept
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return kept.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= limit).drop("_rank")


#: Live rows extend a bout; the first kind also opens one.
LIVE = ("LIVE_SEED", "LIVE_SUPPORT")


def bouts(df: DataFrame, keys: list[str], time: str, tie: str, state: str, between: float, bridge: float, first: str | None = None, last: str | None = None, calm: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Live intervals by automaton over LIVE_SEED, LIVE_SUPPORT, BETWEEN_POINTS and UNKNOWN rows: keys, start, end,
    live_rows, end_source, and transition, the time a calm close stands for.

    A seed opens; seed and support extend. BETWEEN rows for `between` close, at the first of them, not before the start. An UNKNOWN
    row ends the wait, and closes at the last live row once that is more than `bridge` ago. Intervals without length are dropped.
    first, last: columns with the times at which a live row's evidence begins and ends; calm: the column with the time that a BETWEEN row
    stands for; all of them the row's own time where they are null or not given.

    Whether a row closes what is open depends on the rows of its BETWEEN run and on the last live row only, not on what is
    open. So rows are numbered by the closing rows before them, and of each number the rows from the first seed on are a bout. bucket: parts of the
    time that one task sorts, all of a key in one if None.

    A pass over buckets reads its rows twice. Rows are kept before each pass, as else df would run twice as often with each.
    """
    keep = written if bucket is not None else lambda rows: rows
    t = F.col(time).cast("double")
    own = lambda c: F.coalesce(F.col(c).cast("double"), t) if c else t
    part = [] if bucket is None else [bucket.alias("_part")]
    at = None if bucket is None else F.col("_part")
    rows = keep(df.select(*keys, t.alias("_t"), F.col(tie).alias("_k"), F.col(state).alias("_s"), own(first).alias("_from"), own(last).alias("_to"), own(calm).alias("_calm"), *part))
    live, idle, order = F.col("_s").isin(*LIVE), F.col("_s") == "BETWEEN_POINTS", ["_t", "_k"]
    rows = keep(carried(rows, keys, at, order, lasts={"_live_t": F.when(live, F.col("_t"))}, befores={"_before": F.col("_s")}))
    fresh = idle & ~F.coalesce(F.col("_before") == "BETWEEN_POINTS", F.lit(False))
    rows = carried(rows, keys, at, order, lasts={"_run": F.when(fresh, F.struct("_t", "_calm"))})
    shut = F.when(idle, F.col("_t") - F.col("_run._t") >= between).when(~live, F.col("_t") - F.col("_live_t") > bridge)
    rows = keep(rows.withColumn("_shut", F.coalesce(shut, F.lit(False)).cast("long")))
    rows = written(carried(rows, keys, at, order, before_sums={"_number": F.col("_shut")}))
    seed = F.when(F.col("_s") == "LIVE_SEED", F.struct("_t", "_k"))
    opened = rows.groupBy(*keys, "_number").agg(F.min(seed).alias("_seed")).filter("_seed is not null")
    place = F.struct("_t", "_k")
    rows = rows.join(by_key(opened), [*keys, "_number"]).filter(place >= F.col("_seed"))
    ended = F.max(F.when(F.col("_shut") == 1, F.struct(idle.alias("calmed"), F.col("_run._calm").alias("calm"))))
    found = rows.groupBy(*keys, "_number").agg(F.min_by("_from", F.when(live, place)).alias("start"), F.max(F.when(live, F.col("_to"))).alias("_to"), F.count_if(live).alias("live_rows"), ended.alias("_shut"))
    end = F.when(F.col("_shut.calmed"), F.greatest("start", "_shut.calm")).otherwise(F.col("_to"))
    source = F.when(F.col("_shut.calmed"), "between").when(F.col("_shut").isNotNull(), "unknown").otherwise("timeline")
    return found.select(*keys, "start", end.alias("end"), "live_rows", source.alias("end_source"), F.when(F.col("_shut.calmed"), F.col("_shut.calm")).alias("transition")).filter("end > start")


def turns(df: DataFrame, keys: list[str], time: str, tie: str, side: str, expected: Column, after: Column, mask: float, first_gap: float, gap: float, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of df that come in turn, and per key how the scan went: accepted, skipped (long), stopped (boolean) and stop_at.

    The first in turn is later than `after` + mask and on the expected side (any if null), at most first_gap behind `after`. The next is the first row on the
    other side; rows before it are skipped. A row more than gap behind the last in turn stops the scan, and is not looked at. Rows with a null side take no part.

    After the first row in turn, the next ones are the rows at which the side changes, up to the first such step that is
    too long: nothing else has to be remembered, whatever the number of rows. after and expected are the same in all rows of a key.
    """
    t = F.col(time).cast("double")
    rows = df.filter(F.col(side).isNotNull()).withColumns({"_t": t, "_after": after.cast("double"), "_want": expected, **({} if bucket is None else {"_part": bucket})})
    rows = rows.filter(F.col("_t") > F.col("_after") + mask)
    place = F.struct("_t", tie)
    right = F.col("_want").isNull() | (F.col(side) == F.col("_want"))
    starts = rows.groupBy(*keys).agg(F.min(F.when(right, place)).alias("_first"))
    rows = rows.join(by_key(starts), keys)
    # From the first row on, a row's side differs from that of the row before it or not.
    inside = place >= F.col("_first")
    order, at = ["_t", tie], None if bucket is None else F.col("_part")
    rows = carried(rows, keys, at, order, befores={"_before": F.when(inside, F.col(side))})
    head = F.coalesce(inside & (F.col("_before").isNull() | (F.col("_before") != F.col(side))), F.lit(False))
    rows = carried(rows.withColumn("_head", head), keys, at, order, befores={"_last": F.when(F.col("_head"), F.col("_t"))})
    late = F.coalesce(F.col("_t") - F.col("_last") > gap, F.col("_t") - F.col("_after") > first_gap)
    stops = rows.groupBy(*keys).agg(F.min(F.when(late, place)).alias("_stop"))
    rows = rows.join(by_key(stops), keys).filter(F.col("_stop").isNull() | (place < F.col("_stop")))
    ended = stops.select(*keys, F.col("_stop").isNotNull().alias("stopped"), F.col("_stop._t").alias("stop_at"))
    counts = rows.groupBy(*keys).agg(F.count_if("_head").alias("accepted"), F.count_if(~F.col("_head")).alias("skipped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.filter("_head").select(*df.columns), ended.join(by_key(counts), keys, "left").select(*keys, zero("accepted"), zero("skipped"), "stopped", "stop_at")


def alternating_scan(df: DataFrame, keys: list[str], time: str, tie: str, side: str, expected: Column, after: Column, first_gap: float, gap: float, bucket: Column | None = None) -> DataFrame:
    """Per key of df: accepted (the tie of the rows in turn, in order), skipped and stopped; see turns, with the mask first_gap and one gap for all steps."""
    found, went = turns(df, keys, time, tie, side, expected, after, first_gap, gap, gap, bucket)
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(tie).cast("long").alias("k")))).alias("_l"))
    every = df.select(*keys).distinct().join(went, keys, "left").join(lists, keys, "left")
    return every.select(*keys, F.coalesce("_l.k", F.array().cast("array<bigint>")).alias("accepted"), F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"), F.coalesce("stopped", F.lit(False)).alias("stopped"))


def leaders(df: DataFrame, keys: list[str], place: list[str], score: str, tie: str, radius: float, limit: int) -> DataFrame:
    """keys, tie, rank (from 1): rows that lead a cluster. By score (then the smaller tie), a row leads if every leader so far is more than radius away in the
    plane or space of `place`; at most `limit` of a key do. Rows with a null take no part.

    A leader can be any distance along the order from what it stands for, so a key is folded whole: it is one frame, with a few dozen rows.
    """
    rows = df.dropna(subset=[*place, score])
    item = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("k"), F.array(*(F.col(c).cast("double") for c in place)).alias("p"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    step = lambda kept, x: F.when((F.size(kept) >= limit) | F.exists(kept, lambda y: apart(y["p"], x["p"]) <= radius), kept).otherwise(F.concat(kept, F.array(x)))
    return whole.select(*keys, F.posexplode(F.aggregate("_all", F.slice("_all", 1, 0), step)).alias("rank", "_x")).select(*keys, F.col("_x.k").alias(tie), (F.col("rank") + 1).alias("rank"))
