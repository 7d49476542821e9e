"""Body features of a pose: arrays of 17 keypoints (x, y) and their confidences, as column expressions.

Keypoints come in the usual order of seventeen: nose, eyes, ears, then shoulders 5-6, elbows 7-8, wrists 9-10, hips
11-12, knees 13-14, ankles 15-16, left before right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.geometry import joint_angle

# Joints of each side, the least confidence of a seen joint, of a usable pose, and what is a ready stance.
SIDES = {"left": (5, 7, 9, 11, 13, 15), "right": (6, 8, 10, 12, 14, 16)}
SEEN, USABLE = 0.2, 0.45
READY_KNEE, READY_STANCE = 150.0, 0.85
BODY = (5, 6, 11, 12, 13, 14, 15, 16)


def _xy(points: Column, i: int) -> tuple[Column, Column]:
    p = F.get(points, i)
    return F.get(p, 0), F.get(p, 1)


def _seen(confidence: Column, *joints: int) -> Column:
    return F.least(*(F.get(confidence, i) for i in joints)) > SEEN


def elbow_angle(points: Column, confidence: Column, side: str) -> Column:
    """Degrees at the elbow, null unless shoulder, elbow and wrist are seen."""
    s, e, w = SIDES[side][:3]
    return F.when(_seen(confidence, s, e, w), joint_angle(*_xy(points, s), *_xy(points, e), *_xy(points, w)))


def knee_angle(points: Column, confidence: Column) -> Column:
    """The smaller angle at a knee of the sides that are seen, null without either."""
    each = [F.when(_seen(confidence, h, k, a), joint_angle(*_xy(points, h), *_xy(points, k), *_xy(points, a))) for h, k, a in (x[3:] for x in SIDES.values())]
    return F.least(*each)


def torso(points: Column) -> Column:
    """Distance from the middle of the shoulders to that of the hips."""
    mid = lambda i, j, k: (_xy(points, i)[k] + _xy(points, j)[k]) / 2
    return F.sqrt((mid(5, 6, 0) - mid(11, 12, 0)) ** 2 + (mid(5, 6, 1) - mid(11, 12, 1)) ** 2)


def usable(confidence: Column) -> Column:
    """Whether the body's joints are seen well enough on average."""
    total = F.lit(0.0)
    for i in BODY:
        total = total + F.get(confidence, i)
    return total / len(BODY) >= USABLE


def ready(points: Column, confidence: Column) -> Column:
    """Knees bent, or feet wide against the torso."""
    width = F.abs(_xy(points, 15)[0] - _xy(points, 16)[0]) / F.nullif(torso(points), F.lit(0.0))
    return F.coalesce(knee_angle(points, confidence) <= READY_KNEE, F.lit(False)) | F.coalesce(width >= READY_STANCE, F.lit(False))


def wrist(points: Column, confidence: Column, side: str) -> tuple[Column, Column]:
    """The wrist from its shoulder in torso lengths, null unless seen. Up is negative y."""
    s, w = SIDES[side][0], SIDES[side][2]
    size = F.nullif(torso(points), F.lit(0.0))
    ok = F.get(confidence, w) > SEEN
    return tuple(F.when(ok, (_xy(points, w)[k] - _xy(points, s)[k]) / size) for k in (0, 1))


def raised_hand(points: Column, confidence: Column) -> Column:
    """The side whose wrist is seen highest, null without one."""
    both = [F.when(F.get(confidence, x[2]) > SEEN, F.struct(_xy(points, x[2])[1].alias("y"), F.lit(name).alias("side"))) for name, x in SIDES.items()]
    return F.array_min(F.array_compact(F.array(*both)))["side"]
