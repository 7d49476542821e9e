"""Point hypotheses from serves, strokes and live bouts: service groups, exchange sequences, superseded and repeated hypotheses.

Every step is a window or a bucketed range join within the keys of a match; only the last one, where a
hypothesis is compared with those kept before it, is a fold, over one island of overlapping live parts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import overlap
from tidemark.operators.ranges import band_pairs, by_key, overlap_pairs
from tidemark.sources.scratch import written


@dataclass(frozen=True)
class Limits:
    """Seconds, but for scores, shares and actions. Fixed values of the production decoder."""

    mask: float = 0.7
    first_return: float = 4.5
    retry: float = 20.0
    end_switch: float = 30.0
    reset: float = 1.0
    search: float = 5.0
    unreturned_score: float = 0.76
    candidate: float = 5.5
    exchange_gap: float = 6.0
    exchange_actions: int = 3
    lookback: float = 6.0
    state_gap: float = 5.0
    promote: float = 0.52
    rest: float = 5.0
    tail: float = 4.0
    least: float = 2.0
    retention: float = 0.90
    pause: float = 0.75
    bare: float = 0.65
    slack: float = 0.5
    same: float = 0.5


def known_end(end: Column) -> Column:
    return F.when(end.isin("near", "far"), end)


def opposite(end: Column) -> Column:
    return F.when(end == "near", "far").when(end == "far", "near")


def same_context(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two serves (end, half, team) come from one service court; unknown teams do not tell serves apart."""
    both = lambda c: (F.coalesce(a[c], F.lit("")) != "") & (F.coalesce(b[c], F.lit("")) != "")
    return a["end"].eqNullSafe(b["end"]) & a["half"].eqNullSafe(b["half"]) & ~(both("team") & F.coalesce(a["team"] != b["team"], F.lit(False)))


def with_return(serves: DataFrame, strokes: DataFrame, keys: list[str], lim: Limits, width: float) -> DataFrame:
    """serves with returned: whether a stroke of the other end comes after the mask and within first_return of the strike."""
    s = serves.filter(known_end(F.col("end")).isNotNull()).select(*keys, "serve_id", opposite(F.col("end")).alias("want"), F.col("strike").alias("_t"))
    points = strokes.select(*keys, F.col("t").alias("_at"), F.col("end").alias("_end"))
    hit = band_pairs(points, s, keys, "_at", F.col("_t") + lim.mask, F.col("_t") + lim.first_return, width, open_low=True)
    hit = hit.filter(F.col("_end") == F.col("want")).select(*keys, "serve_id").distinct().withColumn("returned", F.lit(True))
    return serves.join(by_key(hit), [*keys, "serve_id"], "left").withColumn("returned", F.coalesce("returned", F.lit(False)))


def service_groups(serves: DataFrame, keys: list[str], lim: Limits) -> DataFrame:
    """serves with group: a serve joins the one before if that was not returned, the step is at most retry, and
    the court is the same or the ends switched within end_switch, which no changeover does."""
    w = Window.partitionBy(*keys).orderBy("strike", "serve_id")
    names = ("end", "half", "team")
    now, before = {c: F.col(c) for c in names}, {c: F.lag(c).over(w) for c in names}
    gap = F.col("strike") - F.lag("strike").over(w)
    switch = F.coalesce((known_end(now["end"]) != known_end(before["end"])) & (gap <= lim.end_switch), F.lit(False))
    joins = (gap <= lim.retry) & ~F.lag("returned").over(w) & (same_context(before, now) | switch)
    rows = serves.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def exchange_sequences(strokes: DataFrame, keys: list[str], lim: Limits) -> DataFrame:
    """keys, first, last, n: runs of strokes of alternating ends with steps of at most exchange_gap, of exchange_actions strokes
    or more. Strokes without a known end take no part."""
    w = Window.partitionBy(*keys).orderBy("t", "stroke_id")
    rows = strokes.filter(known_end(F.col("end")).isNotNull())
    new = (F.col("t") - F.lag("t").over(w) > lim.exchange_gap) | (F.col("end") == F.lag("end").over(w))
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).drop("_run").filter(F.col("n") >= lim.exchange_actions)


def _served(serves: DataFrame, bouts: DataFrame, keys: list[str], duration: float, lim: Limits, width: float) -> tuple[DataFrame, DataFrame]:
    """The hypothesis of each service group that shows play, and the stretches they cover."""
    order = F.struct("strike", "serve_id")
    one = F.struct("serve_id", "strike", "setup", "end", "score", "returned")
    groups = serves.groupBy(*keys, "group").agg(F.min_by(F.when(F.col("returned"), one), F.when(F.col("returned"), order)).alias("back"), F.max_by(one, order).alias("last"), F.min("setup").alias("cover"), F.count("*").alias("attempts"))
    chosen = groups.select(*keys, "group", "cover", "attempts", F.coalesce("back", "last").alias("s"))
    chosen = chosen.select(*keys, "group", "cover", "attempts", "s.*")
    a = chosen.select(*keys, "group", (F.col("strike") - lim.reset).alias("a_start"), F.least(F.col("strike") + lim.search, F.lit(duration)).alias("a_end"))
    b = bouts.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "transition")
    size = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    # The bout that overlaps most, then the longer, then the earlier one.
    best = F.max(F.struct(size.alias("o"), (F.col("b_end") - F.col("b_start")).alias("d"), (-F.col("b_start")).alias("s"), F.col("b_end").alias("e"), F.col("transition").alias("t")))
    found = overlap_pairs(a, b, keys, width).groupBy(*keys, "group").agg(best.alias("best"))
    rows = chosen.join(by_key(found), [*keys, "group"], "left").filter(F.col("returned") | F.col("best").isNotNull() | (F.coalesce("score", F.lit(0.0)) >= lim.unreturned_score))
    rows = written(rows.withColumn("live_end", F.coalesce("best.e", "strike")))
    kind = F.when(F.col("returned"), "returned_serve").when(F.col("best").isNotNull(), "serve_with_play").otherwise("unreturned_serve")
    out = rows.select(*keys, F.lit("serve").alias("kind"), F.col("setup").alias("start"), F.col("strike").alias("live_start"), "live_end", known_end(F.col("end")).alias("server_end"), "attempts", kind.alias("classification"), "serve_id", F.col("best").isNotNull().alias("has_bout"), F.col("best.t").alias("transition"), F.lit(0).cast("long").alias("seed_n"), F.lit(None).cast("double").alias("seed_last"))
    return out, rows.select(*keys, F.col("cover").alias("a_start"), F.greatest("live_end", F.col("strike") + 1.0).alias("a_end"))


def _unserved(bouts: DataFrame, covered: DataFrame, sequences: DataFrame, keys: list[str], lim: Limits, width: float) -> DataFrame:
    """The hypothesis of each long bout that no service covers, from its longest exchange where it has one."""
    long = bouts.filter(F.col("end") - F.col("start") >= lim.candidate).select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "transition")
    gone = overlap_pairs(covered, long, keys, width).filter(overlap(*map(F.col, ("a_start", "a_end", "b_start", "b_end"))) > lim.same).select(*keys, "b_start", "b_end").distinct()
    alone = long.join(by_key(gone), [*keys, "b_start", "b_end"], "left_anti")
    inside = overlap_pairs(sequences.select(*keys, F.col("first").alias("a_start"), F.col("last").alias("a_end"), "n"), alone.select(*keys, (F.col("b_start") - lim.slack).alias("b_start"), (F.col("b_end") + lim.slack).alias("b_end"), F.col("b_start").alias("s"), F.col("b_end").alias("e")), keys, width)
    inside = inside.filter((F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end")))
    seed = inside.groupBy(*keys, F.col("s").alias("b_start"), F.col("e").alias("b_end")).agg(F.max(F.struct("n", (-F.col("a_start")).alias("f"), F.col("a_end").alias("l"))).alias("seed"))
    rows = alone.join(by_key(seed), [*keys, "b_start", "b_end"], "left").withColumn("first", -F.col("seed.f"))
    begin = F.when(F.col("first").isNotNull(), F.greatest("b_start", F.col("first") - lim.lookback)).otherwise(F.col("b_start"))
    seeded = lambda yes, no: F.when(F.col("first").isNotNull(), yes).otherwise(no)
    return rows.select(
        *keys, seeded("exchange", "live_state").alias("kind"), F.greatest(begin, F.lit(0.0)).alias("start"), F.coalesce("first", "b_start").alias("live_start"), F.col("b_end").alias("live_end"),
        F.lit(None).cast("string").alias("server_end"), F.lit(0).cast("long").alias("attempts"), seeded("exchange_only", "play_only").alias("classification"),
        F.lit(None).alias("serve_id"), F.lit(True).alias("has_bout"), "transition", F.coalesce("seed.n", F.lit(0)).cast("long").alias("seed_n"), F.col("seed.l").cast("double").alias("seed_last"),
    )


def _once(rows: DataFrame, keys: list[str], lim: Limits) -> DataFrame:
    """Of hypotheses whose live parts share more than `same`, the first by start stays, or in its place a serve that comes later."""
    fields = ("start", "late", "live_start", "live_end", "kind", "server_end", "attempts", "classification", "serve_id", "has_bout", "transition", "seed_n", "seed_last")
    rows = rows.withColumn("late", (F.col("kind") != "serve").cast("int"))
    w = Window.partitionBy(*keys).orderBy("live_start", "live_end")
    before = F.max("live_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce((F.col("live_start") >= before).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h"))
    alike = lambda a, b: F.least(a["live_end"], b["live_end"]) - F.greatest(a["live_start"], b["live_start"]) > lim.same

    def step(kept: Column, h: Column) -> Column:
        first = F.array_position(F.transform(kept, lambda k: alike(k, h)), True)
        swap = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (h["kind"] == "serve") & (k["kind"] != "serve"), h).otherwise(k))
        return F.when(first == 0, F.concat(kept, F.array(h))).otherwise(swap)

    kept = F.aggregate("h", F.slice("h", 1, 0), step)
    return each.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.*").drop("late")


def point_hypotheses(serves: DataFrame, strokes: DataFrame, bouts: DataFrame, keys: list[str], duration: float, lim: Limits | None = None, width: float = 60.0) -> DataFrame:
    """keys, kind (serve, exchange or live_state), start, live_start, live_end, server_end, attempts, classification, serve_id (of the attempt
    that counts), has_bout, transition, and of an exchange's strokes seed_n and seed_last.

    serves: keys, serve_id, strike, setup, end, half, team, score (accepted ones); strokes: keys, stroke_id, t, end;
    bouts: keys, start, end, and transition where the bout was closed by a calm stretch (a column of that name, if there is one). Rows with a
    null time are left out; an empty table gives none.

    Serves that retry form a group, of which the first returned one counts, else the last. An unserved live_state falls
    when the next unserved hypothesis begins within state_gap of its end.
    """
    lim = lim or Limits()
    if "transition" not in bouts.columns:
        bouts = bouts.withColumn("transition", F.lit(None).cast("double"))
    serves, strokes, bouts = serves.filter("strike is not null"), strokes.filter("t is not null"), written(bouts.filter("start <= end"))
    grouped = service_groups(with_return(serves.withColumn("setup", F.coalesce("setup", "strike")), strokes, keys, lim, width), keys, lim)
    served, covered = _served(grouped, bouts, keys, duration, lim, width)
    alone = _unserved(bouts, covered, exchange_sequences(strokes, keys, lim), keys, lim, width)
    w = Window.partitionBy(*keys).orderBy("start", "live_end")
    gap = F.lead("start").over(w) - F.col("live_end")
    alone = alone.withColumn("_gone", (F.col("kind") == "live_state") & F.coalesce(gap.between(0.0, lim.state_gap), F.lit(False))).filter(~F.col("_gone")).drop("_gone")
    alone = alone.withColumn("serve_id", F.col("serve_id").cast(served.schema["serve_id"].dataType))
    return _once(served.unionByName(alone), keys, lim)
