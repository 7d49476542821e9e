"""From serves and live intervals to point intervals: hypotheses, endpoints and the quality gate of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import overlap
from tidemark.operators.ranges import overlap_pairs


def _order(keys: list[str], *more: str):
    return Window.partitionBy(*keys).orderBy("start", F.when(F.col("kind") == "serve", 0).otherwise(1), *more)


def hypotheses(serves: DataFrame, bouts: DataFrame, keys: list[str], search: float, uncovered: float, supersede: float, width: float) -> DataFrame:
    """keys, kind (serve or live_state), start, live_end, score, has_bout.

    A serve (event_id, t, score) takes the bout (start, end) that overlaps t..t+search most, then the
    longer, then the later one; without a bout its live part is empty. Bouts that no serve's live part
    covers by more than `uncovered` stand alone, but fall when the next of them follows within `supersede` of their end.
    """
    a = serves.select(*keys, "event_id", "score", F.col("t").alias("a_start"), (F.col("t") + search).alias("a_end"))
    b = bouts.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    size = overlap(*map(F.col, ("a_start", "a_end", "b_start", "b_end")))
    best = F.max(F.struct(size.alias("o"), (F.col("b_end") - F.col("b_start")).alias("d"), F.col("b_start").alias("s"), F.col("b_end").alias("e")))
    found = overlap_pairs(a, b, keys, width).groupBy(*keys, "event_id").agg(best.alias("best"))
    hit = serves.join(found, [*keys, "event_id"], "left")
    served = hit.select(*keys, F.lit("serve").alias("kind"), F.col("t").alias("start"), F.coalesce("best.e", "t").alias("live_end"), "score", F.col("best").isNotNull().alias("has_bout"))
    spans = served.select(*keys, F.col("start").alias("a_start"), F.col("live_end").alias("a_end"))
    covered = overlap_pairs(spans, b, keys, width).filter(size > uncovered).select(*keys, F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct()
    alone = bouts.join(covered, [*keys, "start", "end"], "left_anti")
    alone = alone.select(*keys, F.lit("live_state").alias("kind"), "start", F.col("end").alias("live_end"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("has_bout"))
    gap = F.lead("start").over(Window.partitionBy(*keys).orderBy("start", "live_end")) - F.col("live_end")
    alone = alone.withColumn("_gone", F.coalesce(gap.between(0, supersede), F.lit(False))).filter("not _gone").drop("_gone")
    return served.unionByName(alone)


def endpoints(hyp: DataFrame, keys: list[str], duration: float, unreturned: float, tail: float, least: float) -> DataFrame:
    """keys, kind, start, end, source, dropped.

    A point ends with its live part, without one `unreturned` after its start, and in any case where the
    next one or the timeline's end comes. It is dropped when more than `tail` of its live part lies
    behind that, or when it is shorter than `least`; the first reason counts.
    """
    limit = F.coalesce(F.lead("start").over(_order(keys, "live_end", "score")), F.lit(duration))
    rows = hyp.withColumn("_limit", limit)
    source = F.when(F.col("has_bout"), "live_end").otherwise("bounded_window")
    end = F.greatest("start", F.least(F.when(F.col("has_bout"), F.col("live_end")).otherwise(F.col("start") + unreturned), "_limit"))
    rows = rows.withColumns({"end": end, "source": source})
    dropped = F.when(F.col("has_bout") & (F.col("live_end") - F.col("end") > tail), "unexplained_tail").when(F.col("end") - F.col("start") < least, "too_short")
    return rows.select(*keys, "kind", "start", "end", "source", dropped.alias("dropped"))


def quality_gate(ends: DataFrame, keys: list[str], retention: float, gap: float, least: int = 3) -> DataFrame:
    """Per key, over its kept points: n, retention (their time in their span), median_gap, bounded_share, and rejected:
    points that tile the span (least or more, dense, and close to each other) say nothing."""
    kept = ends.filter("dropped is null")
    w = Window.partitionBy(*keys).orderBy("start", "end")
    rows = kept.withColumn("_gap", F.greatest(F.lead("start").over(w) - F.col("end"), F.lit(0.0)))
    rows = rows.withColumn("_gap", F.when(F.lead("start").over(w).isNotNull(), F.col("_gap")))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.sum(F.col("end") - F.col("start")) / (F.max("end") - F.min("start"))).alias("retention"),
        F.percentile("_gap", F.lit(0.5)).alias("median_gap"),
        F.avg((F.col("source") == "bounded_window").cast("int")).alias("bounded_share"),
    )
    return out.withColumn("rejected", F.coalesce((F.col("n") >= least) & (F.col("retention") >= retention) & (F.col("median_gap") <= gap), F.lit(False)))
