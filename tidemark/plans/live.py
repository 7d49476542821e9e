"""Live evidence around each frame: what both ends of the court show within a window, and the state that follows.

A window holds counts of frames (both ends seen, relaxed; per end seen, ready, active), of events (serves, strokes), of pairs of
neighbouring events that alternate between the ends, and of answers by the other end, and the span of its evidence. All counts are differences of
running counts at the two borders of the window: borders are rows of the timeline like frames and events, so
one sorted pass serves every window, whatever its length. Time is cut into buckets; rows near a bucket's edge are also given to its
neighbour, so a bucket is complete in itself and no task holds a whole match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators.prefix import carried
from tidemark.operators.ranges import band_pairs, by_key
from tidemark.plans.service import opposite
from tidemark.sources.scratch import written

ENDS = ("near", "far")


@dataclass(frozen=True)
class Evidence:
    """Fixed values of the production decoder. Times in milliseconds, speeds in torso lengths and metres a second, the rest shares."""

    half: int = 1000
    answer_from: int = 150
    answer_to: int = 1750
    two_sided: float = 0.45
    end_ready: float = 0.20
    end_active: float = 0.20
    arm_speed: float = 0.55
    court_speed: float = 0.55
    relaxed: float = 0.60
    players: int = 2
    relaxed_ready: float = 0.30
    relaxed_wrist: float = 1.75


def flags(c: Evidence) -> dict[str, Column]:
    """Of a player in a frame: whether its arm is active, whether its feet are, and whether that makes its end active."""
    arm = F.coalesce(F.bround("wrist_speed", 4) >= c.arm_speed, F.lit(False))  # speeds are kept with four decimals
    feet = F.coalesce(F.bround("court_speed", 4) >= c.court_speed, F.lit(False))
    ready = F.coalesce(F.col("ready"), F.lit(False))
    return {"ready": ready, "arm": arm, "feet": feet, "active": arm | (ready & feet)}


def frames(players: DataFrame, keys: list[str], c: Evidence = Evidence(), times: DataFrame | None = None) -> DataFrame:
    """One row per frame, keys and ms: visible, two_sided, ready_share, wrist (median), relaxed, support (someone is ready or has an active arm), and for
    each end whether it is seen, ready and active.

    players: keys, ms, actor_id, end, ready, wrist_speed, court_speed; rows that repeat an actor in a frame are one player. Null
    measures count as 0, ends other than near and far are neither. times: keys, ms of all sampled frames, so that frames without a player are there too.
    """
    one = players.filter("ms is not null").groupBy(*keys, "ms", "actor_id").agg(F.max(F.struct("end", "ready", "wrist_speed", "court_speed")).alias("_p")).select(*keys, "ms", "actor_id", "_p.*").withColumns(flags(c))
    any_of = lambda what, end: F.coalesce(F.bool_or(F.col(what) & (F.col("end") == end)), F.lit(False))
    found = one.groupBy(*keys, "ms").agg(
        F.count("*").alias("visible"),
        F.avg(F.col("ready").cast("int")).alias("ready_share"),
        F.median(F.coalesce("wrist_speed", F.lit(0.0))).alias("wrist"),
        F.bool_and(F.coalesce(F.col("end").isin(*ENDS), F.lit(False))).alias("_known"),
        F.bool_or(F.col("ready") | F.col("arm")).alias("support"),
        *(F.coalesce(F.bool_or(F.col("end") == e), F.lit(False)).alias(f"{e}_seen") for e in ENDS),
        *(any_of(what, e).alias(f"{e}_{what}") for e in ENDS for what in ("ready", "active")),
    )
    if times is not None:
        found = times.select(*keys, "ms").distinct().join(by_key(found), [*keys, "ms"], "left")
        found = found.withColumns({name: F.coalesce(name, F.lit(0).cast(kind)) for name, kind in found.dtypes if kind in ("bigint", "double") and name not in (*keys, "ms")})
        found = found.withColumns({name: F.coalesce(name, F.lit(False)) for name, kind in found.dtypes if kind == "boolean" and name not in keys})
    two = (F.col("visible") >= c.players) & F.col("near_seen") & F.col("far_seen") & F.col("_known")
    calm = (F.col("ready_share") <= c.relaxed_ready) & (F.col("wrist") <= c.relaxed_wrist)
    return found.withColumn("two_sided", two).withColumn("relaxed", F.col("two_sided") & calm).drop("_known")


def answers(events: DataFrame, seen: DataFrame, keys: list[str], c: Evidence = Evidence(), width: int = 60_000) -> DataFrame:
    """events with answer: when the other end first answers within the response times: its first active frame, or the second of
    its ready ones if that comes earlier. Null without one, or where the event's end is not known."""
    events = written(events)  # read twice, and numbered by a pass that reads its own rows twice
    own = events.select(*keys, "event_no", F.col("ms").alias("_t"), opposite(F.col("end")).alias("_want")).filter("_want is not null")
    points = seen.select(*keys, F.col("ms").alias("_at"), *(f"{e}_{what}" for e in ENDS for what in ("ready", "active")))
    near = band_pairs(points, own, keys, "_at", F.col("_t") + c.answer_from, F.col("_t") + c.answer_to, width)
    of = lambda what: F.when(F.when(F.col("_want") == "near", F.col(f"near_{what}")).otherwise(F.col(f"far_{what}")), F.col("_at"))
    # Two smallest of the ready times: at most a response's frames, some twenty of them.
    found = near.groupBy(*keys, "event_no").agg(F.min(of("active")).alias("_active"), F.get(F.array_sort(F.collect_set(of("ready"))), F.lit(1)).alias("_second"))
    return events.join(by_key(found.select(*keys, "event_no", F.least("_active", "_second").alias("answer"))), [*keys, "event_no"], "left")


def numbered(serves: DataFrame, strokes: DataFrame, keys: list[str], bucket: int = 60_000) -> DataFrame:
    """Serves and strokes (keys, ms, actor_id, end) as events: kind, event_no (from 0 in order of time, serves first), and back: when the event
    before was, if the two are on different ends. One task sorts one bucket of time."""
    rows = serves.select(*keys, "ms", "actor_id", "end", F.lit("serve").alias("kind")).unionByName(strokes.select(*keys, "ms", "actor_id", "end", F.lit("stroke").alias("kind")))
    rows = rows.filter("ms is not null").withColumn("end", F.when(F.col("end").isin(*ENDS), F.col("end")))
    rows = carried(rows, keys, F.floor(F.col("ms") / bucket), ["ms", "kind", "actor_id"], before_sums={"event_no": F.lit(1)}, befores={"_before": F.struct("ms", "end")})
    return rows.withColumn("back", F.when(F.col("_before.end") != F.col("end"), F.col("_before.ms"))).drop("_before")


def windows(seen: DataFrame, events: DataFrame, keys: list[str], c: Evidence = Evidence(), bucket: int = 60_000) -> DataFrame:
    """One row per frame of seen: n_frames and the shares of the window (two_sided_share, relaxed_share, ready and active of each end), n_events, n_serves, n_strokes,
    n_pairs, n_answers, evidence_start, evidence_end, between_start, seed_reasons and state.

    seen: as of frames; events: as of numbered and answers. The window is [ms - half, ms + half], borders included. Shares of an end are of the frames that
    show it, 0 if none does. Serves, alternating pairs and answered strokes seed; both ends ready, and either both active or with
    any event, support; both ends relaxed without any event lie between points; all else is unknown. An event at ms without a frame
    counts in windows of other frames.
    """
    if c.answer_to > 2 * c.half:
        raise ValueError("a window must be as long as the longest response")
    shares = [f"{e}_{what}" for e in ENDS for what in ("seen", "ready", "active")]
    counted = ["frame", "two_sided", "relaxed", *shares, "event", "serve", "stroke", "pair_end", "pair_begin", "answer_end", "answer_begin"]

    def of(rows: DataFrame, at: Column, counts: dict[str, Column], evidence: Column | None = None, calm: Column | None = None, begin: Column | None = None, end: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("long")
        return rows.select(*keys, (at if begin is None else begin).alias("_begin"), (at if end is None else end).alias("_end"), at.cast("long").alias("at"), *(F.coalesce(counts.get(x, F.lit(0)).cast("long"), F.lit(0)).alias(x) for x in counted), (none if evidence is None else evidence).cast("long").alias("evidence"), (none if calm is None else calm).cast("long").alias("calm"))

    events = written(events)  # read in five parts of the timeline
    t, one = F.col("ms"), F.lit(1)
    gap = t - F.col("back")
    paired = events.filter(gap.between(c.answer_from, c.answer_to))
    answered = events.filter("answer is not null")
    data = of(seen, t, {"frame": one, "two_sided": F.col("two_sided"), "relaxed": F.col("relaxed")} | {x: F.col(x) for x in shares}, F.when(F.col("support"), t), F.when(F.col("relaxed"), t))
    for part in (
        of(events, t, {"event": one, "serve": F.col("kind") == "serve", "stroke": F.col("kind") == "stroke"}, t),
        of(paired, t, {"pair_end": one}, begin=F.col("back")),
        of(paired, F.col("back"), {"pair_begin": one}, end=t),
        of(answered, F.col("answer"), {"answer_end": one}, begin=t),
        of(answered, t, {"answer_begin": one}, end=F.col("answer")),
    ):
        data = data.unionByName(part)
    # A bucket's windows reach half beyond it. A pair or an answer goes with both its times to every bucket that either can matter to.
    cell = lambda x: F.floor(x / bucket).cast("long")
    data = data.withColumn("bucket", F.explode(F.sequence(cell(F.col("_begin") - c.half), cell(F.col("_end") + c.half)))).withColumns({"side": F.lit(1), "ms": F.lit(None).cast("long")})
    border = of(seen, t, {}).withColumn("bucket", cell(F.col("at"))).withColumn("ms", F.col("at"))
    low = border.withColumns({"at": F.col("at") - c.half, "side": F.lit(0)})
    high = border.withColumns({"at": F.col("at") + c.half, "side": F.lit(2)})
    # Low borders come before what happens at their time, high ones after it.
    rows = data.unionByName(low).unionByName(high)
    part = Window.partitionBy(*keys, "bucket")
    upto = part.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    onward = part.orderBy(F.col("at").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({x: F.sum(x).over(upto) for x in counted} | {"_last": F.max("evidence").over(upto)})
    rows = rows.withColumns({"_first": F.min("evidence").over(onward), "_calm": F.min("calm").over(onward)})
    at_high, at_low = F.col("side") == 2, F.col("side") == 0
    # Pairs and answers inside the window: those that end in time, less those that began too early. Both sets of times rise together.
    upper = lambda x: F.max(F.when(at_high, F.col(x)))
    lower = lambda x: F.max(F.when(at_low, F.col(x)))
    plain = ["frame", "two_sided", "relaxed", *shares, "event", "serve", "stroke"]
    got = rows.filter("ms is not null").groupBy(*keys, "bucket", "ms").agg(
        *((upper(x) - lower(x)).alias(x) for x in plain),
        F.greatest(upper("pair_end") - lower("pair_begin"), F.lit(0)).alias("n_pairs"),
        F.greatest(upper("answer_end") - lower("answer_begin"), F.lit(0)).alias("n_answers"),
        upper("_last").alias("_last"), lower("_first").alias("_first"), lower("_calm").alias("_calm"),
    )
    share = lambda x, of_: F.col(x) / F.greatest(F.col(of_), F.lit(1))
    got = got.withColumns({"two_sided_share": share("two_sided", "frame"), "relaxed_share": share("relaxed", "frame")} | {f"{e}_{what}_share": share(f"{e}_{what}", f"{e}_seen") for e in ENDS for what in ("ready", "active")})
    both = lambda what, least: F.least(*(F.col(f"{e}_{what}_share") for e in ENDS)) >= least
    two = F.col("two_sided_share") >= c.two_sided
    quiet = (F.col("event") == 0) & (F.col("n_answers") == 0)
    reasons = F.filter(F.array(F.when(F.col("serve") > 0, "serve"), F.when(F.col("n_pairs") > 0, "alternating_pair"), F.when((F.col("n_answers") > 0) & (F.col("stroke") > 0), "answered_stroke")), lambda x: x.isNotNull())
    support = two & both("ready", c.end_ready) & (both("active", c.end_active) | ~quiet)
    between = two & (F.col("relaxed_share") >= c.relaxed) & quiet
    state = F.when(F.size("seed_reasons") > 0, "LIVE_SEED").when(support, "LIVE_SUPPORT").when(between, "BETWEEN_POINTS").otherwise("UNKNOWN")
    inside = lambda x: (F.col(x) >= F.col("ms") - c.half) & (F.col(x) <= F.col("ms") + c.half)
    return got.withColumn("seed_reasons", reasons).select(
        *keys, "ms", F.col("frame").alias("n_frames"), "two_sided_share", "relaxed_share", *(f"{e}_{what}_share" for e in ENDS for what in ("ready", "active")),
        F.col("event").alias("n_events"), F.col("serve").alias("n_serves"), F.col("stroke").alias("n_strokes"), "n_pairs", "n_answers",
        F.when(inside("_first"), F.col("_first")).alias("evidence_start"), F.when(inside("_last"), F.col("_last")).alias("evidence_end"),
        F.when(between & inside("_calm"), F.col("_calm")).alias("between_start"), "seed_reasons", state.alias("state"),
    )


def bouts(states: DataFrame, keys: list[str], between: int = 1000, bridge: int = 1000, bucket: int = 600_000) -> DataFrame:
    """Live bouts (start, end, live_rows, end_source, transition, in seconds) from windows: evidence, not the frames' own times, begins and ends them. Evidence that
    begins at 0 counts as none."""
    rows = states.withColumn("_from", F.when(F.col("evidence_start") != 0, F.col("evidence_start")))
    found = folds.bouts(rows, keys, "ms", "state", "state", float(between), float(bridge), "_from", "evidence_end", "between_start", bucket=F.floor(F.col("ms") / bucket))
    return found.withColumns({c: F.col(c) / 1000.0 for c in ("start", "end", "transition")})


def actor_evidence(players: DataFrame, some: DataFrame, keys: list[str], c: Evidence = Evidence(), width: int = 60_000) -> DataFrame:
    """For each window of some (keys, ms) and each player in it: end, frames observed, ready, arm_active and feet_active, and their shares."""
    rows = players.filter("ms is not null").groupBy(*keys, "ms", "actor_id").agg(F.max(F.struct("end", "ready", "wrist_speed", "court_speed")).alias("_p")).select(*keys, F.col("ms").alias("_at"), "actor_id", "_p.*").withColumns(flags(c))
    pairs = band_pairs(rows, some.select(*keys, F.col("ms")), keys, "_at", F.col("ms") - c.half, F.col("ms") + c.half, width)
    counts = pairs.groupBy(*keys, "ms", "end", "actor_id").agg(F.count("*").alias("observed"), *(F.count_if(x).alias(n) for x, n in (("ready", "ready"), ("arm", "arm_active"), ("feet", "feet_active"))))
    return counts.withColumns({f"{n}_share": F.col(n) / F.col("observed") for n in ("ready", "arm_active", "feet_active")})
