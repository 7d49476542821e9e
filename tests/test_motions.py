"""Serve and stroke detection against plain loops on random poses."""

import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import motions

C = motions.Thresholds()
LENGTH, NET = 23.77, 11.885


def poses(seed, n=160, pace=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for actor in ("a", "b"):
        ms, phase = 0, rng.random() * 6
        for _ in range(n):
            ms += int(rng.choice([83, 160, 170, 400, 900], p=[0.3, 0.3, 0.3, 0.08, 0.02]))
            t = ms / 1000
            r = {"actor_id": actor, "ms": ms, "court_x": 3 + math.sin(t / 9) + rng.normal(0, 0.1), "court_y": float(rng.choice([1.0, 23.0, 9.0], p=[0.8, 0.1, 0.1])), "ready": bool(rng.random() < 0.4), "knee": None if rng.random() < 0.2 else float(rng.uniform(140, 175)), "associated": bool(rng.random() < 0.1), "racket_hand": str(rng.choice(["left", "right"]))}
            r["actor_end"] = "near" if r["court_y"] < NET else "far"
            for k, h in enumerate(("left", "right")):
                there = rng.random() < 0.9
                r[f"{h}_x"] = float(0.6 * math.sin(3 * pace * t + phase + k) + rng.normal(0, 0.05)) if there else None
                r[f"{h}_y"] = float(-0.5 * math.sin(2.2 * pace * t + phase) + rng.normal(0, 0.05)) if there else None
                r[f"{h}_over"] = -r[f"{h}_y"] if there else None
                r[f"{h}_speed"] = float(rng.uniform(0, 2)) if there else None
                r[f"{h}_elbow"] = float(rng.uniform(80, 170)) if rng.random() < 0.9 else None
            r["over_ratio"] = max((r[f"{h}_over"] for h in ("left", "right") if r[f"{h}_over"] is not None), default=-1.0)
            out.append(r)
    return out, sorted(rng.choice(30_000, 60, replace=False).tolist())


SCHEMA = "actor_id string, ms long, court_x double, court_y double, ready boolean, knee double, associated boolean, racket_hand string, actor_end string, " + ", ".join(f"{h}_{c} double" for h in ("left", "right") for c in ("x", "y", "over", "speed", "elbow")) + ", over_ratio double"


def base(y):
    return y <= 1.5 or y >= LENGTH - 1.5


def onset(mine, p, h):
    run, later = [], p["ms"]
    for r in sorted((r for r in mine if p["ms"] - 2500 <= r["ms"] <= p["ms"]), key=lambda r: -r["ms"]):
        if later - r["ms"] > 800 or r["actor_end"] != p["actor_end"] or not base(r["court_y"]) or abs(r["court_x"] - p["court_x"]) > 1.8:
            break
        run.append(r)
        later = r["ms"]
    seen = [r for r in run if r[f"{h}_over"] is not None]
    if len(seen) < 3:
        return max(0, p["ms"] - 2500)
    low = min(r[f"{h}_over"] for r in seen)
    at = max(r["ms"] for r in seen if r[f"{h}_over"] <= low + 0.03)
    return min([r["ms"] for r in seen if at - 650 <= r["ms"] <= at and r["knee"] is not None and r["knee"] <= 155] or [at])


def brute_serves(rows, opposed):
    found = []
    for actor in ("a", "b"):
        mine = [r for r in rows if r["actor_id"] == actor]
        for p in mine:
            cut = lambda a, b: [r for r in mine if p["ms"] + a <= r["ms"] <= p["ms"] + b]  # noqa: B023, E731
            pre, near, post = cut(-1350, -100), cut(-300, 300), cut(80, 700)
            if not base(p["court_y"]) or len(pre) < 2:
                continue
            for h in ("left", "right"):
                o = p[f"{h}_over"]
                lows = [r[f"{h}_over"] for r in pre if r[f"{h}_over"] is not None]
                after = [(r[f"{h}_x"], r[f"{h}_y"]) for r in post if r[f"{h}_x"] is not None]
                if o is None or o < 0.25 or o < max(r[f"{h}_over"] if r[f"{h}_over"] is not None else -1 for r in near) or not lows or not after:
                    continue
                rise, fast = max(0, o - min(lows)), max(r[f"{h}_speed"] or 0 for r in near)
                follow = max(math.hypot(x - p[f"{h}_x"], y - p[f"{h}_y"]) for x, y in after)
                side = max(abs(x - p[f"{h}_x"]) for x, _ in after)
                racket = sum(r["associated"] and r["racket_hand"] == h for r in pre + near + post)
                knees = [r["knee"] for r in [*pre, p, *post] if r["knee"] is not None]
                drive = max(knees) - min(knees) if len(knees) > 1 else 0
                load = sum(r["ready"] for r in pre) + sum(r["knee"] is not None and r["knee"] <= 155 for r in pre)
                span = max(np.ptp([r["court_x"] for r in pre]), np.ptp([r["court_y"] for r in pre]))
                facing = sum(abs(t - p["ms"]) <= 450 for t in opposed)
                move = max(0, (post[-1]["court_y"] - p["court_y"]) * (1 if p["court_y"] < NET else -1)) if post else 0
                pushed = drive >= 12 or move >= 0.12 or racket or (facing and follow >= 0.27)
                done = follow >= 0.18 and (side >= 0.15 or racket or fast >= 0.8125)
                ok = bool(rise >= 0.22 and fast >= 0.65 and load and done and span <= 1.8 and pushed)
                score = 0.18 * min(o / 0.25, 1) + 0.17 * min(rise / 0.22, 1) + 0.18 * min(fast / 0.65, 1.8) / 1.8 + 0.1 * min(follow / 0.18, 1) + 0.07 * min(side / 0.15, 1) + 0.1 * min(load, 1) + 0.08 * min(max(move / 0.25, drive / 12), 1) + 0.06 * min(facing / 2, 1) + 0.04 * max(0, 1 - span / 1.8) + 0.02 * min(racket, 1)
                found.append((bool(ok and score >= 0.66), round(float(score), 4), actor, p["ms"], h, onset(mine, p, h)))
    kept = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1])):
        if all(abs(x[3] - y[3]) >= 1250 for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def brute_strokes(rows, serve_times):
    out = []
    for actor in ("a", "b"):
        mine = [dict(r) for r in rows if r["actor_id"] == actor]
        soft = []
        for r in mine:
            at = {}
            for h in ("left", "right"):
                v = [(q[f"{h}_x"], q[f"{h}_y"]) for q in mine if abs(q["ms"] - r["ms"]) <= 180 and q[f"{h}_x"] is not None]
                at[h] = tuple(statistics.median(c) for c in zip(*v)) if v else None
            soft.append(at)
        for i, p in enumerate(mine):
            if any(abs(p["ms"] - s) <= 700 for s in serve_times):
                continue
            pre = [j for j, r in enumerate(mine) if p["ms"] - 450 <= r["ms"] <= p["ms"] - 80]
            post = [j for j, r in enumerate(mine) if p["ms"] + 80 <= r["ms"] <= p["ms"] + 500]
            best = []
            for h in ("left", "right"):
                here = soft[i][h]
                b, a = [soft[j][h] for j in pre if soft[j][h]], [soft[j][h] for j in post if soft[j][h]]
                if not here or len(b) < 2 or not a or p[f"{h}_elbow"] is None:
                    continue
                mid = lambda v: np.array([statistics.median(c) for c in zip(*v)])
                k = max(1, len(b) // 2)
                early, loaded, after, here = mid(b[:k]), mid(b[k:]), mid(a), np.array(here)
                prep, go, end = loaded - early, here - loaded, after - here
                n = np.linalg.norm
                cos = lambda u, v: float(u @ v / (n(u) * n(v))) if n(u) * n(v) > 1e-9 else 0.0  # noqa: B023, E731
                speed = 0.0
                for x, y in ((i - 1, i), (i, i + 1)):
                    if x >= 0 and y < len(mine) and soft[x][h] and soft[y][h] and 0 < mine[y]["ms"] - mine[x]["ms"] <= 350:
                        speed = max(speed, math.dist(soft[x][h], soft[y][h]) / ((mine[y]["ms"] - mine[x]["ms"]) / 1000))
                elbow = p[f"{h}_elbow"]
                before = [mine[j][f"{h}_elbow"] for j in pre if mine[j][f"{h}_elbow"] is not None]
                gain = elbow - statistics.median(before) if before else 0
                through, turn, fc = n(after - loaded), cos(prep, go) <= -0.1 or prep[0] * go[0] <= -0.025, cos(go, end)
                kind = None
                if speed >= 0.85 and n(prep) >= 0.18 and n(go) >= 0.16 and n(end) >= 0.18 and through >= 0.38 and abs(after[0] - loaded[0]) >= 0.24 and elbow >= 85 and turn and fc >= -0.25:
                    kind = "ground"
                if abs(p["court_y"] - NET) <= 3.5 and speed >= 0.85 * 0.85 and n(prep) >= 0.12 and n(go) >= 0.14 and n(end) >= 0.14 and through >= 0.3 and elbow >= 105 and gain >= 4 and turn and fc >= -0.15:
                    kind = "compact"
                if p["over_ratio"] >= 0.15 and speed >= 0.9 * 0.85 and n(prep) >= 0.12 and n(go) >= 0.14 and n(end) >= 0.18 and through >= 0.3 and turn and fc >= -0.2:
                    kind = "overhead"
                score = min(0.99, 0.3 * min(speed / 0.85, 1.5) / 1.5 + 0.2 * min(n(prep) / 0.18, 1) + 0.2 * min(n(end) / 0.18, 1) + 0.15 * min(through / 0.38, 1) + 0.1 * min(elbow / 150, 1) + 0.05 * turn + 0.05 * p["associated"])
                if kind and score >= 0.66:
                    best.append((score, n(prep) + n(go) + n(end) + through, kind, h))
            if best:
                s, _, kind, h = max(best, key=lambda x: x[:2])
                out.append((actor, p["ms"], kind, h, round(float(s), 4)))
    return sorted(out)


def test_serves_equal_brute_force(spark):
    total = 0
    for seed in (1, 2):
        rows, opposed = poses(seed)
        pose = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).withColumn("match", F.lit(1))
        seen = spark.createDataFrame([(1, t) for t in opposed], "match int, ms long")
        got = motions.serves(pose, seen, ["match"]).orderBy("ms").collect()
        want = brute_serves(rows, opposed)
        assert [(r.accepted, r.score, r.actor_id, r.ms, r.hand, r.setup_ms) for r in got] == want
        total += sum(w[0] for w in want)
    assert total > 3


def test_strokes_equal_brute_force(spark):
    rows, _ = poses(3, pace=2.2)
    pose = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).withColumn("match", F.lit(1))
    serve = spark.createDataFrame([(1, 5000), (1, 9100)], "match int, ms long")
    got = sorted((r.actor_id, r.ms, r.action, r.hand, r.confidence) for r in motions.stroke_proposals(pose, serve, ["match"]).collect())
    want = brute_strokes(rows, [5000, 9100])
    assert got == want and len(want) > 5
    episodes = motions.strokes(pose, serve, ["match"]).collect()
    assert 0 < len(episodes) <= len(want)
