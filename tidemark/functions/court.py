"""Column expressions over people on a court: where a box stands, whether that belongs to the court, and boxes cut for a model or a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The court and the ground around it that still belongs to play, in metres; pads of boxes as shares of their size; least sizes in pixels.
WIDTH, LENGTH = 10.97, 23.77
APRON_SIDE, APRON_END = 1.5, 3.0
WIDEN = (0.12, 0.07, 0.12, 0.06)
LEAST_BOX, LEAST_CROP = (4, 8), (12, 24)
CROP = (0.12, 0.10, 0.12, 0.10)


def finite(*columns: Column) -> Column:
    """Whether all values are there, and numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def observation(box: list[Column], width: Column, height: Column) -> Column:
    """Of a box in pixels (left, top, right, low): struct of foot_x, foot_y and area as shares of the frame."""
    x0, y0, x1, y1 = box
    return F.struct(((x0 + x1) / (2.0 * width)).alias("foot_x"), (y1 / height).alias("foot_y"), ((x1 - x0) * (y1 - y0) / (width * height)).alias("area"))


def on_apron(x: Column, y: Column, area: Column) -> Column:
    """Whether a point of the court plane is on the court or the ground around it, seen with some area."""
    return finite(x, y, area) & x.between(-APRON_SIDE, WIDTH + APRON_SIDE) & y.between(-APRON_END, LENGTH + APRON_END) & (area > 0)


def widened(box: list[Column], width: Column, height: Column) -> Column:
    """A box in shares of the frame, widened by WIDEN inside it, in pixels: left, top, right, low; null if it is then smaller than LEAST_BOX or not finite."""
    x0, y0, x1, y1 = box
    w, h = x1 - x0, y1 - y0
    left, right = F.greatest(x0 - WIDEN[0] * w, F.lit(0.0)) * width, F.least(x1 + WIDEN[2] * w, F.lit(1.0)) * width
    top, low = F.greatest(y0 - WIDEN[1] * h, F.lit(0.0)) * height, F.least(y1 + WIDEN[3] * h, F.lit(1.0)) * height
    large = (right - left >= LEAST_BOX[0]) & (low - top >= LEAST_BOX[1])
    return F.when(finite(*box) & large, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), low.alias("low")))


def crop(box: list[Column], width: Column, height: Column) -> Column:
    """The whole pixels to cut out around a box in pixels; null if they are fewer than LEAST_CROP."""
    x0, y0, x1, y1 = box
    pad_x, pad_y = CROP[0] * (x1 - x0), CROP[1] * (y1 - y0)
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    left, top = F.greatest(whole(x0 - pad_x), F.lit(0)), F.greatest(whole(y0 - pad_y), F.lit(0))
    right, low = F.least(whole(x1 + pad_x), width.cast("long")), F.least(whole(y1 + pad_y), height.cast("long"))
    large = (right - left >= LEAST_CROP[0]) & (low - top >= LEAST_CROP[1])
    return F.when(finite(*box) & large, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), low.alias("low")))


def suggested_slot(foot_x: Column, foot_y: Column, mid_x: Column, mid_y: Column, doubles: Column) -> Column:
    """The roster slot of a foot point: near is low in the frame; in doubles each end has a left and a right one. Null middles are the frame's."""
    near, left = foot_y >= F.coalesce(mid_y, F.lit(0.5)), foot_x < F.coalesce(mid_x, F.lit(0.5))
    four = F.when(near & left, "P1").when(near, "P2").when(left, "P3").otherwise("P4")
    return F.when(doubles, four).otherwise(F.when(near, "P1").otherwise("P2"))
