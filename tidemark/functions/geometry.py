"""Plane geometry as column expressions, and the small linear solve for homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PARALLEL = 1e-9


def project(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 homography given by rows; null where the point goes to infinity."""
    a = [F.lit(float(v)) for v in h]
    w = a[6] * x + a[7] * y + a[8]
    ok = F.abs(w) > 1e-12
    return F.when(ok, (a[0] * x + a[1] * y + a[2]) / w), F.when(ok, (a[3] * x + a[4] * y + a[5]) / w)


def solve_homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> list[float]:
    """The homography that takes four points to four others, as nine numbers by rows."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*map(float, np.linalg.solve(np.array(rows, float), np.array(right, float))), 1.0]


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The angle at b in degrees; null where a limb has no length."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cos = (ux * vx + uy * vy) / size
    return F.when(size > PARALLEL, F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; 0 where the union is empty."""
    zero = F.lit(0.0)
    inner = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda r: F.greatest(r[2] - r[0], zero) * F.greatest(r[3] - r[1], zero)
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(zero)


def line_crossing(p: list[Column], q: list[Column]) -> tuple[Column, Column]:
    """Where the infinite lines through two segments x1, y1, x2, y2 cross; null when they are parallel."""
    dx1, dy1, dx2, dy2 = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    cross = dx1 * dy2 - dy1 * dx2
    at = ((q[0] - p[0]) * dy2 - (q[1] - p[1]) * dx2) / cross
    ok = F.abs(cross) >= PARALLEL
    return F.when(ok, p[0] + at * dx1), F.when(ok, p[1] + at * dy1)


def folded_angle(dx: Column, dy: Column) -> Column:
    """Angle of a line against the horizontal in degrees, 0 to 90."""
    a = F.abs(F.degrees(F.atan2(dy, dx)))
    return F.least(a, 180 - a)


def quad_area(points: list[tuple[Column, Column]]) -> Column:
    """Shoelace area of a polygon, signed by its direction."""
    pairs = zip(points, [*points[1:], points[0]], strict=True)
    total = F.lit(0.0)
    for (x1, y1), (x2, y2) in pairs:
        total = total + x1 * y2 - x2 * y1
    return total / 2


def convex(points: list[tuple[Column, Column]]) -> Column:
    """Whether all turns of a polygon go the same way."""
    n, turns = len(points), []
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = points[i], points[(i + 1) % n], points[(i + 2) % n]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)
