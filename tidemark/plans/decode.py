"""From hypotheses to points: which strokes are in turn, where a point ends and why, which are dropped, and whether the whole is believed.

Every stroke belongs to the last hypothesis that begins before it, found by one carried pass over both in order of time; the
scan for strokes in turn then runs inside the stretch up to the next hypothesis, each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import turns
from tidemark.operators.prefix import carried
from tidemark.operators.ranges import band_pairs, by_key
from tidemark.plans.service import Limits, known_end, opposite, with_return
from tidemark.sources.scratch import written


def promoted(serves: DataFrame, strokes: DataFrame, keys: list[str], lim: Limits = Limits(), width: float = 60.0) -> DataFrame:
    """serves with accepted: as given, or where the motions of a serve came in order (evidence), its score is at least `promote` and
    the other end returned it. Nulls are false and 0."""
    rows = with_return(serves, strokes, keys, lim, width)
    raised = F.coalesce("evidence", F.lit(False)) & (F.coalesce("score", F.lit(0.0)) >= lim.promote) & F.col("returned")
    return rows.withColumn("accepted", F.coalesce("accepted", F.lit(False)) | raised).drop("returned")


def _ordered(hyp: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", (F.col("kind") != "serve").cast("int"), "live_start", "live_end")
    return hyp.withColumns({"no": F.row_number().over(order) - 1, "next_start": F.coalesce(F.lead("start").over(order), duration)})


def assigned(rows: DataFrame, strokes: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """The strokes between live_start and next_start of a served hypothesis, with its no, live_start and server_end."""
    h = F.struct("no", "kind", "live_start", "next_start", "server_end")
    marks = rows.select(*keys, F.col("start").alias("t"), F.lit(0).alias("_side"), F.col("no").cast("long").alias("_tie"), h.alias("_h"))
    own = strokes.select(*keys, "t", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct("stroke_id", "end").alias("_s"))
    both = marks.unionByName(own, allowMissingColumns=True)
    both = carried(both, keys, F.floor(F.col("t") / bucket), ["t", "_side", "_tie"], lasts={"_now": F.col("_h")})
    inside = (F.col("_now.kind") == "serve") & (F.col("t") > F.col("_now.live_start")) & (F.col("t") < F.col("_now.next_start"))
    return both.filter("_s is not null").filter(inside).select(*keys, F.col("_now.no").alias("no"), F.col("_now.live_start").alias("live_start"), F.col("_now.server_end").alias("server_end"), "t", F.col("_s.stroke_id").alias("stroke_id"), known_end(F.col("_s.end")).alias("end"))


def decoded(hyp: DataFrame, strokes: DataFrame, keys: list[str], duration: float | Column, lim: Limits = Limits(), width: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """The decisions, one row per hypothesis, and the strokes in turn of served ones (keys, no, seq from 1, role, t, stroke_id, end).

    hyp: as of service.point_hypotheses; strokes: keys, stroke_id, t, end. Decisions have hyp's columns and no, next_start, accepted_actions, rejected_actions (out
    of turn, of no known end, or the one that came too late), raw_actions (all strokes from start to end), last_action, last_evidence, end, tail, source, confidence and dropped (null if kept).

    A point ends where a calm stretch began, else with its live part, else `rest` after its last action; never before its
    start or after the next hypothesis or the duration. It is dropped when that lies more than `tail` behind the last evidence, or
    when it is shorter than `least`; the first reason counts. Hypotheses with equal starts go serve first, then by live part. Null stroke times are left out;
    no hypotheses give no rows.
    """
    limit = duration if isinstance(duration, Column) else F.lit(float(duration))
    strokes = strokes.filter("t is not null")
    rows = written(_ordered(hyp, keys, limit))
    mine = written(assigned(rows, strokes, keys, width))
    found, went = turns(mine, [*keys, "no"], "t", "stroke_id", "end", opposite(F.col("server_end")), F.col("live_start"), lim.mask, lim.first_return, lim.exchange_gap)
    place = Window.partitionBy(*keys, "no").orderBy("t", "stroke_id")
    found = found.withColumn("seq", F.row_number().over(place)).withColumn("role", F.when(F.col("seq") == 1, "return").otherwise("exchange"))
    last = found.groupBy(*keys, "no").agg(F.max("t").alias("_last"))
    late = F.col("t") > F.col("live_start") + lim.mask
    unknown = mine.filter(F.col("end").isNull() & late).join(by_key(went.select(*keys, "no", "stop_at")), [*keys, "no"], "left")
    unknown = unknown.filter(F.col("stop_at").isNull() | (F.col("t") < F.col("stop_at"))).groupBy(*keys, "no").agg(F.count("*").alias("_unknown"))
    for part in (went, last, unknown):
        rows = rows.join(by_key(part), [*keys, "no"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.withColumns({
        "accepted_actions": F.when(F.col("kind") == "serve", zero("accepted")).otherwise(zero("seed_n")),
        "rejected_actions": zero("skipped") + F.coalesce(F.col("stopped").cast("long"), F.lit(0)) + zero("_unknown"),
        "live_end": F.least("live_end", "next_start", limit),
        "last_action": F.greatest("live_start", F.when(F.col("kind") == "serve", F.col("_last")).otherwise(F.col("seed_last"))),
    })
    rows = rows.withColumn("last_evidence", F.greatest("last_action", "live_end"))
    cases = [(F.col("transition").isNotNull(), F.col("transition"), "calm_stretch", "high"), (F.col("live_end") > F.col("live_start"), F.col("live_end"), "live_end", "medium"), (F.lit(True), F.least("next_start", F.col("last_action") + lim.rest), "bounded_window", "low")]
    pick = lambda i: F.coalesce(*(F.when(c[0], c[i] if isinstance(c[i], Column) else F.lit(c[i])) for c in cases))
    rows = rows.withColumns({"end": F.greatest("start", F.least(pick(1), "next_start", limit)), "source": pick(2), "confidence": pick(3)})
    rows = rows.withColumn("tail", F.greatest(F.col("end") - F.col("last_evidence"), F.lit(0.0)))
    dropped = F.when(F.col("tail") > lim.tail + 1e-6, "unexplained_tail").when(F.col("end") - F.col("start") < lim.least, "too_short").when((F.col("kind") == "live_state") & ~F.col("has_bout"), "no_live_state")
    rows = written(rows.withColumn("dropped", dropped))
    counts = band_pairs(strokes.select(*keys, F.col("t").alias("_at")), rows.select(*keys, "no", F.col("start").alias("_a"), F.col("end").alias("_b")), keys, "_at", F.col("_a"), F.col("_b"), width)
    rows = rows.join(by_key(counts.groupBy(*keys, "no").agg(F.count("*").alias("_raw"))), [*keys, "no"], "left").withColumn("raw_actions", zero("_raw"))
    columns = [*(c for c in hyp.columns if c != "live_end"), "live_end", "no", "next_start", "accepted_actions", "rejected_actions", "raw_actions", "last_action", "last_evidence", "end", "tail", "source", "confidence", "dropped"]
    return rows.select(*columns), found.select(*keys, "no", "seq", "role", "t", "stroke_id", "end")


def quality(decisions: DataFrame, keys: list[str], duration: float | Column, lim: Limits = Limits(), fewest: int = 3) -> DataFrame:
    """Per key with a decision: n (kept points), retention (their share of the duration), median_gap (null for fewer than two), bare_share (of points without a stroke
    behind the serve), violations (kept points with too long a tail), warned, rejected and reason.

    Points that tile nearly all of the source, `fewest` of them or more, with hardly a pause between them, isolate nothing: all are rejected. So are
    points that break the bound of the tail. Many bare points are only warned of. A duration of 0 or less retains nothing.
    """
    limit = duration if isinstance(duration, Column) else F.lit(float(duration))
    rows = decisions.withColumn("_kept", F.col("dropped").isNull())
    order = Window.partitionBy(*keys, "_kept").orderBy("start", "end", "no")
    rows = rows.withColumn("_gap", F.when(F.col("_kept"), F.greatest(F.lead("start").over(order) - F.col("end"), F.when(F.lead("start").over(order).isNotNull(), 0.0))))
    kept = lambda c: F.when(F.col("_kept"), c)
    out = rows.groupBy(*keys).agg(
        F.count_if("_kept").alias("n"),
        F.coalesce(F.sum(kept(F.col("end") - F.col("start"))) / F.max(F.when(limit > 0, limit)), F.lit(0.0)).alias("retention"),
        F.percentile("_gap", F.lit(0.5)).alias("median_gap"),
        F.coalesce(F.avg(kept(((F.col("kind") == "serve").cast("long") + F.col("accepted_actions") <= 1).cast("int"))), F.lit(0.0)).alias("bare_share"),
        F.count_if(F.col("_kept") & (F.round("tail", 3) > lim.tail)).alias("violations"),
    )
    tiled = F.coalesce((F.col("n") >= fewest) & (F.col("retention") >= lim.retention) & (F.col("median_gap") <= lim.pause), F.lit(False))
    reason = F.when(F.col("violations") > 0, "unbounded_tails").when(tiled, "tiled_source")
    return out.withColumns({"warned": F.col("bare_share") > lim.bare, "rejected": (F.col("violations") > 0) | tiled, "reason": reason})


def after_intro(decisions: DataFrame, seconds: float) -> DataFrame:
    """The kept points that begin `seconds` after the start of the source or later; with 0 or less, all kept ones."""
    kept = decisions.filter("dropped is null")
    return kept.filter(F.col("start") >= seconds) if seconds > 0 else kept
