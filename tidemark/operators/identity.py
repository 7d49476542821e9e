"""Appearance vectors, formats of a match and assignment of tracklets to identities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine_distance, l2_normalised
from tidemark.operators.folds import suppressed


def median_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per key, the element-wise median of its vectors at unit length, as column centre."""
    flat = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.percentile("_x", F.lit(0.5)).alias("_m"))
    whole = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return whole.select(*keys, l2_normalised(F.col("_v._m")).alias("centre"))


def dominant_side(df: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """Per key: n, side (the more frequent of 0 and 1, 0 on ties) and purity, its share."""
    ones = F.sum(side.cast("long"))
    out = df.groupBy(*keys).agg(F.count(side).alias("n"), ones.alias("_ones"))
    zero = F.col("n") - F.col("_ones")
    return out.select(*keys, "n", F.when(zero >= F.col("_ones"), 0).otherwise(1).alias("side"), F.when(F.col("n") > 0, F.greatest(zero, F.col("_ones")) / F.col("n")).otherwise(0.0).alias("purity"))


def profiles(seen: DataFrame, match: str) -> DataFrame:
    """Per track of seen (match, ms, track, end, ...): n, first (its earliest ms), end (the one it is on more often, near on ties) and purity (that share)."""
    rows = seen.filter("track is not null").groupBy(match, "track").agg(F.count("*").alias("n"), F.min("ms").alias("first"), F.count_if(F.col("end") == "near").alias("_near"))
    far = F.col("n") - F.col("_near")
    return rows.select(match, "track", "n", "first", F.when(F.col("_near") >= far, "near").otherwise("far").alias("end"), (F.greatest("_near", far) / F.col("n")).alias("purity"))


def anchors(seen: DataFrame, tracks: DataFrame, formats: DataFrame, match: str, pure: float = 0.80) -> DataFrame:
    """match, slot (from 0: near by court_x, then far), track and end of the players that stand for the identities.

    They are the largest per_end rows (formats: match, per_end) of each end in the frame where these are largest in sum, the earliest of equals, counting
    only tracks that keep to that end. A match without a frame that fills both ends takes, for each end, the tracks seen there most often (then
    with the larger area, then the greater number), each where its area is largest. Matches that cannot fill both ends have none.
    """
    steady = tracks.filter(F.col("purity") >= pure).select(match, "track", "end")
    rows = seen.filter("track is not null").join(steady, [match, "track", "end"]).join(formats, match)
    fills = lambda df, keys: df.groupBy(*keys).agg(F.sum("area").alias("_area"), F.count("*").alias("_k"), F.first("per_end").alias("_need")).filter("_k = 2 * _need")
    largest = Window.partitionBy(match, "ms", "end").orderBy(F.col("area").desc(), "track")
    top = rows.withColumn("_r", F.row_number().over(largest)).filter("_r <= per_end")
    best = fills(top, [match, "ms"]).groupBy(match).agg(F.max_by("ms", F.struct("_area", -F.col("ms"))).alias("ms"))
    framed = top.join(best, [match, "ms"]).select(match, "track", "end", "court_x")
    one = rows.groupBy(match, "track", "end", "per_end").agg(F.count("*").alias("_on"), F.max_by(F.struct("area", "court_x"), F.struct("area", -F.col("ms"))).alias("_o"))
    often = Window.partitionBy(match, "end").orderBy(F.col("_on").desc(), F.col("_o.area").desc(), F.col("track").desc())
    strong = one.join(best.select(match), match, "left_anti").withColumn("_r", F.row_number().over(often)).filter("_r <= per_end").withColumn("area", F.col("_o.area"))
    strong = strong.join(fills(strong, [match]).select(match), match, "left_semi").select(match, "track", "end", F.col("_o.court_x").alias("court_x"))
    place = Window.partitionBy(match).orderBy(F.when(F.col("end") == "near", 0).otherwise(1), "court_x", "track")
    return framed.unionByName(strong).select(match, (F.row_number().over(place) - 1).alias("slot"), "track", "end")


def _centre(vectors: list[np.ndarray]) -> np.ndarray | None:
    if not vectors:
        return None
    middle = np.median(np.stack(vectors), axis=0)
    return middle / max(float(np.linalg.norm(middle)), 1e-9)


def assign_identities(seen: DataFrame, formats: DataFrame, match: str, most: float = 0.22, pure: float = 0.80) -> DataFrame:
    """match, track, end, purity, slot (null: a fragment of nobody known) and distance, for every track that keeps to one end.

    seen: match, ms, track, end, area, court_x, appearance (array, null if unknown); formats: match, per_end. Rows without a track take no
    part. The tracks of `anchors` are the identities. The others go longest first (the earlier, then the smaller number of equals): each joins the identity of its end
    whose appearance is nearest, at most `most` away (1 - cosine, the smaller slot of equals), if the two are never seen at one time. The
    identity's appearance is the element-wise median over all its rows on its end, taken anew after each track. That order is the
    method, so a match is one group; a match is as long as its video. Matches without anchors have no identities.
    """
    tracks = profiles(seen, match)
    found = anchors(seen, tracks, formats, match, pure)
    rows = seen.filter("track is not null").join(tracks.select(match, "track", "n", "first", F.col("end").alias("_end"), "purity"), [match, "track"])
    rows = rows.select(F.col(match).alias("match"), "track", "ms", F.col("end").alias("side"), "appearance", "n", "first", "_end", "purity")

    def run(own: pd.DataFrame, anchor: pd.DataFrame) -> pd.DataFrame:
        groups = {t: g for t, g in own.groupby("track")}
        looks = lambda g: [np.asarray(v, float) for v in g["appearance"] if v is not None and len(v)]
        anchor = anchor.sort_values("slot")
        slot_of = dict(zip(anchor["anchor"], anchor["slot"], strict=True))
        ends = list(anchor["at"])
        mine = [groups[t][groups[t]["side"] == e] for t, e in zip(anchor["anchor"], ends, strict=True)]
        vectors, busy = [looks(g) for g in mine], [set(g["ms"]) for g in mine]
        centres, away = [_centre(v) for v in vectors], {t: 0.0 for t in slot_of}
        heads = own.drop_duplicates("track").sort_values(["n", "first", "track"], ascending=[False, True, True])
        for t, end, purity in zip(heads["track"], heads["_end"], heads["purity"], strict=True):
            look = None if t in slot_of or purity < pure else _centre(looks(groups[t]))
            if look is None:
                continue
            times = set(groups[t]["ms"])
            near = [(1.0 - float(np.clip(c @ look, -1.0, 1.0)), i) for i, c in enumerate(centres) if c is not None and ends[i] == end and not times & busy[i]]
            if near and min(near)[0] <= most:
                away[t], i = min(near)
                slot_of[t] = i
                vectors[i] += looks(groups[t][groups[t]["side"] == ends[i]])
                busy[i] |= times
                centres[i] = _centre(vectors[i])
        kept = heads[heads["purity"] >= pure]
        return pd.DataFrame({match: kept["match"], "track": kept["track"], "end": kept["_end"], "purity": kept["purity"], "slot": pd.array([slot_of.get(t) for t in kept["track"]], "Int64"), "distance": pd.array([away.get(t) for t in kept["track"]], "Float64")})

    schema = f"{match} {seen.schema[match].dataType.simpleString()}, track {seen.schema['track'].dataType.simpleString()}, end string, purity double, slot long, distance double"
    anchor = found.select(F.col(match).alias("_m"), F.col("slot").alias("slot"), F.col("track").alias("anchor"), F.col("end").alias("at"))
    return rows.groupBy("match").cogroup(anchor.groupBy("_m")).applyInPandas(run, schema)


def inspection_rows(seen: DataFrame, assigned: DataFrame, match: str, most: float = 0.28, apart: float = 750.0, limit: int = 40) -> DataFrame:
    """match, slot, ms, area, rank (by area): rows that show a player, at most `limit`, largest first, no two less than `apart` milliseconds from
    each other, none further than `most` from the player's median appearance. Rows without an appearance may stand. The first three are thumbnails."""
    rows = seen.join(assigned.filter("slot is not null").select(match, "track", "end", "slot"), [match, "track", "end"])
    flat = F.transform("appearance", lambda v: v.cast("double"))
    middle = median_vector(rows.filter("appearance is not null").withColumn("appearance", flat), [match, "slot"], "appearance")
    rows = rows.join(middle, [match, "slot"], "left")
    far = F.when(F.col("appearance").isNotNull() & F.col("centre").isNotNull(), cosine_distance(flat, F.col("centre")))
    fit = rows.filter(far.isNull() | (far <= most)).groupBy(match, "slot", "ms").agg(F.max("area").alias("area"))
    kept = suppressed(fit.withColumn("_tie", F.col("ms")), [match, "slot"], "ms", "area", "_tie", apart, limit)
    order = Window.partitionBy(match, "slot").orderBy(F.col("area").desc(), "ms")
    return kept.select(match, "slot", "ms", "area").withColumn("rank", F.row_number().over(order))


def public_roster(assigned: DataFrame, inspected: DataFrame, match: str, thumbnails: int = 3) -> DataFrame:
    """match, id (P1 and on, by slot), team (T1 near, T2 far), tracks (ascending) and thumbnails (the times of the largest inspection rows, largest first)."""
    own = assigned.filter("slot is not null").groupBy(match, "slot").agg(F.min_by("end", F.struct("distance", "track")).alias("_end"), F.array_sort(F.collect_list("track")).alias("tracks"))
    best = inspected.filter(F.col("rank") <= thumbnails).groupBy(match, "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "ms"))).alias("_t"))
    rows = own.join(best, [match, "slot"], "left")
    none = F.array().cast("array<bigint>")
    return rows.select(match, F.concat(F.lit("P"), (F.col("slot") + 1).cast("string")).alias("id"), F.when(F.col("_end") == "near", "T1").otherwise("T2").alias("team"), "tracks", F.coalesce("_t.ms", none).alias("thumbnails"))


def detections(frames: DataFrame, detector, schema: str) -> DataFrame:
    """The boundary to a model: detector(iterator of pandas frames) on each partition, one worker a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from detector(batches)

    return frames.mapInPandas(run, schema)
