"""Pairs of boxes that overlap, by a grid with a cell size for each size of box.

A box lies in at most four cells of its own level, whose cells are at least as large as the box. Two boxes meet on the coarser of their two levels, so a box
is also given to the coarser levels that occur (a few dozen at most: levels are powers of two). Each pair is found once, in the cell in which the
overlap's lower left corner lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels are clipped to these powers of two; boxes beyond them lie in more, or share larger cells.
LOWEST, HIGHEST = -20, 40


def _levelled(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    side = F.greatest(x1 - x0, y1 - y0)
    level = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(F.greatest(side, F.lit(2.0**LOWEST)))))).cast("int")
    return df.filter((x0 <= x1) & (y0 <= y1)).withColumn("_own", level)


def _cells(df: DataFrame, box: tuple[str, str, str, str], levels: list[int]) -> DataFrame:
    rows = df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda lv: lv >= F.col("_own"))))
    size = F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda c: F.floor(F.col(c) / size)
    rows = rows.withColumn("_cx", F.explode(F.sequence(cell(box[0]), cell(box[2]))))
    return rows.withColumn("_cy", F.explode(F.sequence(cell(box[1]), cell(box[3]))))


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str]) -> DataFrame:
    """Every pair of a box of a and one of b of the same keys that touch or overlap, with both rows' columns (which must not clash). Boxes are
    left, low, right, high; those with a null bound or right < left hold nothing and meet none. Equal boxes pair like others."""
    left, right = _levelled(a, a_box), _levelled(b, b_box)
    levels = sorted({r[0] for side in (left, right) for r in side.select("_own").distinct().collect()})  # HIGHEST - LOWEST + 1 at most
    if not levels:
        levels = [0]
    left, right = _cells(left, a_box, levels), _cells(right, b_box, levels).withColumnRenamed("_own", "_other")
    size = F.pow(F.lit(2.0), F.col("_level"))
    corner = lambda i: F.floor(F.greatest(a_box[i], b_box[i]) / size)
    meet = (F.col(a_box[0]) <= F.col(b_box[2])) & (F.col(b_box[0]) <= F.col(a_box[2])) & (F.col(a_box[1]) <= F.col(b_box[3])) & (F.col(b_box[1]) <= F.col(a_box[3]))
    once: Column = (F.greatest("_own", "_other") == F.col("_level")) & (corner(0) == F.col("_cx")) & (corner(1) == F.col("_cy"))
    return left.join(right, [*keys, "_level", "_cx", "_cy"]).filter(meet & once).drop("_level", "_cx", "_cy", "_own", "_other")


def best_boxes(a: DataFrame, b: DataFrame, keys: list[str], a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str], b_id: str, score: Column, least: float, name: str) -> DataFrame:
    """Each row of a whose box meets boxes of b with a score of at least `least`: its columns, b_id of the one with the highest, the smallest at equal scores, and
    `name`, that score.

    score: a column over both boxes' bounds. Equal boxes of one key are one before pairs are made, so pairs grow with the different boxes that meet, not with rows.
    """
    ours, theirs = a.select(*keys, *a_box).distinct(), b.groupBy(*keys, *b_box).agg(F.min(b_id).alias(b_id))
    pairs = box_pairs(ours, theirs, keys, a_box, b_box).withColumn(name, score).filter(F.col(name) >= least)
    best = pairs.groupBy(*keys, *a_box).agg(F.max_by(b_id, F.struct(name, -F.col(b_id))).alias(b_id), F.max(name).alias(name))
    return a.join(best, [*keys, *a_box])
