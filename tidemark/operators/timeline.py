"""Window operators over one key's rows in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], time: str, tie: str):
    return Window.partitionBy(*keys).orderBy(time, tie)


def collapse_near(df: DataFrame, keys: list[str], time: str, tie: str, gap: float) -> DataFrame:
    """Of rows less than gap apart the later replaces the earlier one."""
    step = F.lead(time).over(_order(keys, time, tie)) - F.col(time)
    return df.withColumn("_step", step).filter(F.col("_step").isNull() | (F.col("_step") >= gap)).drop("_step")


def centred_speed(df: DataFrame, keys: list[str], time: str, tie: str, value: str, most: float, unit: float) -> DataFrame:
    """speed: the greater of the change per unit of time from the row before and to the row after, of steps
    in (0, most]; 0 without either."""
    w = _order(keys, time, tie)

    def rate(dt: Column, dv: Column) -> Column:
        return F.when((dt > 0) & (dt <= most), F.abs(dv) / (dt / unit))

    back = rate(F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w))
    ahead = rate(F.lead(time).over(w) - F.col(time), F.lead(value).over(w) - F.col(value))
    return df.withColumn("speed", F.coalesce(F.greatest(back, ahead), F.lit(0.0)))


def local_maxima(df: DataFrame, keys: list[str], time: str, tie: str, value: str, least: float, span: float) -> DataFrame:
    """Rows that are the greatest of the five around them (two on each side), which span at most `span`."""
    w = _order(keys, time, tie)
    five = w.rowsBetween(-2, 2)
    width = F.lead(time, 2).over(w) - F.lag(time, 2).over(w)
    rows = df.withColumns({"_top": F.max(value).over(five), "_width": width})
    return rows.filter((F.col("_width") <= span) & (F.col(value) >= least) & (F.col(value) == F.col("_top"))).drop("_top", "_width")


def median_smoothed(df: DataFrame, keys: list[str], time: str, value: str, radius: int) -> DataFrame:
    """smooth: the exact median of the values within radius of the row's time, both ends included."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(-radius, radius)
    return df.withColumn("smooth", F.percentile(value, F.lit(0.5)).over(w))


def enrolled(df: DataFrame, keys: list[str], time: str, tie: str, inside: Column) -> DataFrame:
    """Rows that are inside, or whose key was inside before; rows without a key only if they are inside."""
    w = _order(keys, time, tie).rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = df.withColumn("_in", inside).withColumn("_ever", F.max(F.col("_in").cast("int")).over(w) == 1)
    return rows.filter(F.col("_in") | (known & F.col("_ever"))).drop("_in", "_ever")


def window_states(df: DataFrame, keys: list[str], time: str, kind: str, side: str, radius: int, seed: tuple[str, ...], support: str, idle: str) -> DataFrame:
    """Each row classified from the rows within radius of its time: LIVE_SEED, LIVE_SUPPORT, BETWEEN_POINTS or
    UNKNOWN, in this order, with the evidence (n_near, n_seed, n_support, idle_share, sides) and the span
    of supporting rows (evidence_start, evidence_end).

    Seed: two seed kinds on both sides, or one and a support. Support: at least two of that kind. Between:
    more than half idle rows.
    """
    is_seed, is_support, is_idle = F.col(kind).isin(*seed), F.col(kind) == support, F.col(kind) == idle
    # Each bucket of time also gets the rows within radius of it. Frames that begin with the bucket only grow, so each row is added once to each of them:
    # up to radius after a row, back to radius before it, and the whole bucket. What both of the first hold is counted twice.
    width = 4 * radius
    cell = lambda x: F.floor(x / width)
    rows = df.withColumn("_home", cell(F.col(time)))
    rows = rows.withColumn("_bucket", F.explode(F.coalesce(F.sequence(cell(F.col(time) - radius), cell(F.col(time) + radius)), F.array(F.lit(None).cast("long")))))
    part = Window.partitionBy(*keys, "_bucket")
    upto, back = part.orderBy(time).rangeBetween(Window.unboundedPreceding, radius), part.orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, radius)
    inner = lambda c: F.count_if(c).over(upto) + F.count_if(c).over(back) - F.count_if(c).over(part)
    evidence = F.when(is_seed | is_support, F.col(time))
    rows = rows.withColumns({
        "n_near": inner(F.lit(True)),
        "_known": inner(F.col(kind).isNotNull()),
        "n_seed": inner(is_seed),
        "n_support": inner(is_support),
        "n_idle": inner(is_idle),
        "_left": inner(is_seed & (F.col(side) == 0)),
        "_right": inner(is_seed & (F.col(side) == 1)),
        "evidence_start": F.min(evidence).over(back),
        "evidence_end": F.max(evidence).over(upto),
    }).filter(F.col("_bucket").eqNullSafe(F.col("_home")))
    rows = rows.withColumns({
        **{n: F.when(F.col("_known") > 0, F.col(n)) for n in ("n_seed", "n_support", "n_idle")},
        "sides": (F.col("_left") > 0).cast("int") + (F.col("_right") > 0).cast("int"),
        "evidence_start": F.when(F.col("evidence_start") <= F.col(time) + radius, F.col("evidence_start")),
        "evidence_end": F.when(F.col("evidence_end") >= F.col(time) - radius, F.col("evidence_end")),
    }).drop("_home", "_bucket", "_known", "_left", "_right")
    state = (
        F.when(((F.col("n_seed") >= 2) & (F.col("sides") == 2)) | ((F.col("n_seed") >= 1) & (F.col("n_support") >= 1)), "LIVE_SEED")
        .when(F.col("n_support") >= 2, "LIVE_SUPPORT")
        .when(2 * F.col("n_idle") > F.col("n_near"), "BETWEEN_POINTS")
        .otherwise("UNKNOWN")
    )
    return rows.withColumn("idle_share", F.col("n_idle") / F.col("n_near")).withColumn("state", state).drop("n_idle")
