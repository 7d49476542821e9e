"""Precision, recall and timing of predicted intervals against reference ones."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.intervals import interval_iou
from tidemark.operators.islands import union_length
from tidemark.operators.prefix import carried
from tidemark.operators.ranges import overlap_pairs
from tidemark.sources.scratch import written


def best_assignment(edges: list[list[tuple[int, float]]], n_columns: int) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest total gain. edges: of each row its (column, gain), gains above 0.

    Shortest augmenting paths over the edges that there are: a row may also stay alone, at no gain, so a search ends near where it began and
    memory grows with the edges, not with rows times columns."""
    u, v, owner, held = [0.0] * len(edges), [0.0] * n_columns, [-1] * n_columns, [-1] * len(edges)
    for start, own in enumerate(edges):
        u[start] = min([0.0, *(-gain - v[c] for c, gain in own)])
        reach, came, settled, heap = {}, {}, {}, [(0.0, start)]
        best, last = float("inf"), None
        while heap:
            d, row = heapq.heappop(heap)
            if d >= best:
                break
            if row in settled:
                continue
            settled[row] = d
            if d - u[row] < best:
                best, last = d - u[row], (row, None)
            for c, gain in edges[row]:
                if owner[c] in settled:  # final, whatever rounding says
                    continue
                far = d - gain - u[row] - v[c]
                if far < min(best, reach.get(c, best)):
                    reach[c], came[c] = far, row
                    if owner[c] < 0:
                        best, last = far, (row, c)
                    else:
                        heapq.heappush(heap, (far, owner[c]))
        for row, d in settled.items():
            u[row] += best - d
        for c, d in reach.items():
            if d < best:
                v[c] -= best - d
        row, c = last
        while True:
            before = held[row]
            held[row] = -1 if c is None else c
            if c is not None:
                owner[c] = row
            if row == start:
                break
            row, c = came[before], before
    return [(row, c) for row, c in enumerate(held) if c >= 0]


def matched(predicted: DataFrame, gold: DataFrame, keys: list[str], least: float, width: float) -> DataFrame:
    """keys, pred_id, gold_id, iou: the one-to-one matching with most pairs of at least `least` (> 0) overlap over
    hull, and among those the greatest sum.

    predicted and gold: keys, id, start, end. A pair that is the only one of both its intervals stands. The rest are matched within stretches that no
    pair reaches across, by the pairs that there are: a stretch is held as its pairs, not as a matrix.
    """
    a = predicted.select(*keys, F.col("id").alias("pred_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = gold.select(*keys, F.col("id").alias("gold_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    pairs = overlap_pairs(a, b, keys, width).withColumn("iou", interval_iou(*map(F.col, ("a_start", "a_end", "b_start", "b_end")))).filter(F.col("iou") >= least)
    pairs = written(pairs.select(*keys, "pred_id", "gold_id", "iou", F.least("a_start", "b_start").alias("start"), F.greatest("a_end", "b_end").alias("end")))
    alone = lambda side: pairs.groupBy(*keys, side).agg(F.count("*").alias(f"_{side}"))
    known = pairs.join(alone("pred_id"), [*keys, "pred_id"]).join(alone("gold_id"), [*keys, "gold_id"])
    plain = (F.col("_pred_id") == 1) & (F.col("_gold_id") == 1)
    sure = known.filter(plain).select(*keys, "pred_id", "gold_id", "iou")
    open_pairs = known.filter(~plain).select(*keys, "pred_id", "gold_id", "iou", "start", "end")
    # Pairs that share an interval overlap, so each component lies within one stretch of the union of its pairs.
    order = ["start", "end", "pred_id", "gold_id"]
    part = F.floor(F.col("start") / width)
    rows = carried(open_pairs, keys, part, order, before_maxes={"_reach": F.col("end")})
    rows = carried(rows.withColumn("_new", F.coalesce((F.col("start") >= F.col("_reach")).cast("long"), F.lit(1))), keys, part, order, sums={"_stretch": F.col("_new")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = {x: i for i, x in enumerate(sorted(frame["pred_id"].unique()))}, {x: i for i, x in enumerate(sorted(frame["gold_id"].unique()))}
        size, edges = min(len(rows), len(cols)) + 1.0, [[] for _ in rows]
        for p, g, iou in zip(frame["pred_id"], frame["gold_id"], frame["iou"], strict=True):
            edges[rows[p]].append((cols[g], size + iou))
        chosen = set(best_assignment(edges, len(cols)))
        keep = [(rows[p], cols[g]) in chosen for p, g in zip(frame["pred_id"], frame["gold_id"], strict=True)]
        return frame[keep][[*keys, "pred_id", "gold_id", "iou"]]

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "pred_id long, gold_id long, iou double"])
    solved = rows.select(*keys, "_stretch", "pred_id", "gold_id", "iou").groupBy(*keys, "_stretch").applyInPandas(run, schema)
    return sure.unionByName(solved)


def scores(matches: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    """precision, recall and f1 of counts: both sides empty is perfect, one empty side is not."""
    p = F.when(predicted > 0, matches / predicted).when(gold == 0, 1.0).otherwise(0.0)
    r = F.when(gold > 0, matches / gold).otherwise(1.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def coverage(predicted: DataFrame, gold: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Per key: time kept, time of gold, time in both, and dead time that was kept all the same."""
    a = predicted.select(*keys, F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = gold.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    inner = overlap_pairs(a, b, keys, width, strict=True).select(*keys, F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))
    size = lambda df, name: union_length(df, keys, width).withColumnRenamed("covered", name)
    out = size(predicted, "kept").join(size(gold, "gold"), keys, "full").join(size(inner, "both"), keys, "left")
    out = out.fillna(0, ["kept", "gold", "both"])
    return out.withColumn("dead", F.greatest(F.col("kept") - F.col("both"), F.lit(0)))

