"""A court from line segments of frames: its outer corners, whether they look like the court that the camera follows, and which lines support it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.court import LENGTH, WIDTH
from tidemark.functions.geometry import folded_angle, line_crossing

# Insets of the court's lines in metres, and how far a line may lean and still count as level.
INSET, SERVICE = 1.37, 5.4864
LEVEL = 35.0
CORNERS = ("near_left", "near_right", "far_right", "far_left")


def model_lines(spark: SparkSession) -> DataFrame:
    """The lines of a court: name, x1, y1, x2, y2 in metres from the near left corner."""
    w, n, s = WIDTH, LENGTH, SERVICE
    rows = [
        ("near_base", 0.0, 0.0, w, 0.0), ("far_base", 0.0, n, w, n), ("left_double", 0.0, 0.0, 0.0, n), ("right_double", w, 0.0, w, n),
        ("left_single", INSET, 0.0, INSET, n), ("right_single", w - INSET, 0.0, w - INSET, n), ("net", 0.0, n / 2, w, n / 2),
        ("near_service", INSET, s, w - INSET, s), ("far_service", INSET, n - s, w - INSET, n - s), ("centre_service", w / 2, s, w / 2, n - s),
    ]
    return spark.createDataFrame(rows, "name string, x1 double, y1 double, x2 double, y2 double")


def outer_corners(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and x, y of each of CORNERS: where the lowest and the highest level line meet the leftmost and the rightmost of the others.

    lines: keys, x1, y1, x2, y2. Lines of no length or with a null take no part. A key with fewer than two lines of either kind, or whose lines are parallel, has
    no row. Of lines of equal height or place the greater one counts."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    angle = folded_angle(ends[2] - ends[0], ends[3] - ends[1])
    rows = lines.dropna(subset=["x1", "y1", "x2", "y2"]).filter("x1 <> x2 or y1 <> y2").withColumn("_level", angle <= LEVEL)
    line, y, x = F.struct(*ends), (ends[1] + ends[3]) / 2, (ends[0] + ends[2]) / 2
    level, steep = F.col("_level"), ~F.col("_level")
    of = lambda which, at: F.max_by(line, F.when(which, F.struct(at, line)))
    found = rows.groupBy(*keys).agg(of(level, y).alias("near"), of(level, -y).alias("far"), of(steep, -x).alias("left"), of(steep, x).alias("right"), F.count_if(level).alias("_n"), F.count_if(steep).alias("_m"))
    part = lambda name: [F.col(f"{name}.{c}") for c in ("x1", "y1", "x2", "y2")]
    out = {}
    for corner in CORNERS:
        for axis, c in zip("xy", line_crossing(part(corner.split("_")[0]), part(corner.split("_")[1])), strict=True):
            out[f"{corner}_{axis}"] = c
    whole = found.filter("_n >= 2 and _m >= 2").select(*keys, *(c.alias(n) for n, c in out.items()))
    return whole.dropna(subset=list(out))


def plausible(width: Column, height: Column, corner: dict[str, tuple[Column, Column]]) -> Column:
    """Whether corners (by the names of CORNERS) belong to the court that the camera follows: none lies more than 3 % of the width beside the frame, and the near edge
    is low in the frame or the far edge's middle nearly above its own. Lines of two courts taken for one drift sideways."""
    inside = F.lit(True)
    for x, _ in corner.values():
        inside = inside & x.between(-0.03 * width, width - 1 + 0.03 * width)
    middle = lambda end, i: (corner[f"{end}_left"][i] + corner[f"{end}_right"][i]) / 2
    deep = middle("near", 1) >= 0.78 * height
    return inside & (deep | (F.abs(middle("near", 0) - middle("far", 0)) <= 0.08 * width))


def supported(expected: DataFrame, seen: DataFrame, keys: list[str], name: str, angle: float, apart: float, overlap: float, length: float) -> DataFrame:
    """The rows of expected (keys, name, x1, y1, x2, y2, in pixels) that one seen line (keys, u1, v1, u2, v2) supports: it is `length` long or more, turned by at most
    `angle` degrees, its middle at most `apart` beside the expected line, and it covers at least the share `overlap` of it.

    Lines shorter than a pixel support nothing and are not supported. A frame's lines are compared with each other, a few dozen either side."""
    x1, y1, u1, v1 = (F.col(c) for c in ("x1", "y1", "u1", "v1"))
    dx, dy, du, dv = F.col("x2") - x1, F.col("y2") - y1, F.col("u2") - u1, F.col("v2") - v1
    size, own = F.hypot(dx, dy), F.hypot(du, dv)
    along = lambda u, v: ((u - x1) * dx + (v - y1) * dy) / size
    turn = F.degrees(F.acos(F.least(F.abs(dx * du + dy * dv) / (size * own), F.lit(1.0))))
    beside = F.abs((((u1 + F.col("u2")) / 2 - x1) * -dy + ((v1 + F.col("v2")) / 2 - y1) * dx) / size)
    a, b = along(u1, v1), along(F.col("u2"), F.col("v2"))
    covered = F.greatest(F.least(size, F.greatest(a, b)) - F.greatest(F.least(a, b), F.lit(0.0)), F.lit(0.0)) / size
    hit = (size >= 1) & (own >= 1) & (own >= length) & (turn <= angle) & (beside <= apart) & (covered >= overlap)
    found = expected.join(seen.select(*keys, "u1", "v1", "u2", "v2"), keys).filter(hit).select(*keys, name).distinct()
    return expected.join(found, [*keys, name], "left_semi")
