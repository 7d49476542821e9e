"""Steps whose work must grow with their rows, not with the pairs of rows near each other."""

import random
import re

from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.geometry import box_iou
from tidemark.operators import ranges, spatial, timeline
from tidemark.plans import live, motions
from tidemark.queries.motions import _poses

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_band_totals_equal_pairs(spark):
    rng = random.Random(5)
    points = [(rng.choice([1, 2, None]), rng.choice([None, *range(-40, 60)]), i, rng.choice([None, 0, 3])) for i in range(300)]
    bands = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-40, 60)]), i) for i in range(90)]
    p, b = spark.createDataFrame(points, "k int, t long, id int, x int"), spark.createDataFrame(bands, "k int, t long, band int")
    for low, high, width in ((-5, 5, 7), (3, 9, 4), (-9, -2, 100), (0, 0, 1)):
        want = {}
        for k, t, i in bands:
            near = sorted((pt, pid, x) for pk, pt, pid, x in points if k is not None and pk == k and None not in (t, pt) and t + low <= pt <= t + high)
            if near:
                known = [x for *_, x in near if x is not None]
                want[i] = (len(near), near[0][:2], sum(known) if known else None)
        got = {r.band: (r.n, tuple(r._first), r.x) for r in ranges.band_totals(p, b, ["k"], "t", low, high, width, {"x": F.col("x")}, "id").collect()}
        assert got == want and len(want) > 20


def test_responses_and_counts_make_no_pairs(spark):
    for name in ("first_response", "band_count"):
        assert "Join" not in planned(queries.queries()[name](spark, SF))


def test_window_states_have_no_sliding_frames(spark):
    rng = random.Random(11)
    kinds, radius = ["seed", "support", "idle", "other", None], 5
    rows = [(d, rng.choice([None, *range(-30, 50)]), rng.choice(kinds), rng.choice([0, 1, None]), i) for i in range(250) for d in [rng.choice([1, 2])]]
    df = spark.createDataFrame(rows, "d int, t long, kind string, side int, id int")
    out = timeline.window_states(df, ["d"], "t", "kind", "side", radius, ("seed",), "support", "idle")
    got = {r.id: (r.n_near, r.n_seed, r.n_support, r.sides, r.evidence_start, r.evidence_end) for r in out.collect()}
    for d, t, _, _, i in rows:
        near = [(u, k, s) for e, u, k, s, _ in rows if e == d and (u is None if t is None else u is not None and abs(u - t) <= radius)]
        told = any(k for _, k, _ in near)
        n = lambda kind: sum(k == kind for _, k, _ in near) if told else None  # noqa: B023, E731
        times = [u for u, k, _ in near if k in ("seed", "support") and u is not None]
        assert got[i] == (len(near), n("seed"), n("support"), len({s for _, k, s in near if k == "seed" and s is not None}), min(times, default=None), max(times, default=None))
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", planned(out))
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_box_argmax_pairs_shapes_not_rows(spark):
    rng = random.Random(3)
    a = [(i % 2, i, float(x), float(y), x + 5.0, y + 4.0) for i in range(60) for x, y in [(rng.randrange(3), rng.randrange(2))]]
    b = [(i % 2, i, float(x), float(y), x + 6.0, y + 5.0) for i in range(50) for x, y in [(rng.randrange(4), rng.randrange(2))]]
    left, right = spark.createDataFrame(a, "f int, i int, x double, y double, x2 double, y2 double"), spark.createDataFrame(b, "f int, j int, u double, v double, u2 double, v2 double")
    score = box_iou([F.col(c) for c in ("x", "y", "x2", "y2")], [F.col(c) for c in ("u", "v", "u2", "v2")])
    got = {r.i: (r.j, round(r.iou, 9)) for r in spatial.best_boxes(left, right, ["f"], ("x", "y", "x2", "y2"), ("u", "v", "u2", "v2"), "j", score, 0.4, "iou").collect()}
    want = {}
    for f, i, x, y, x2, y2 in a:
        found = []
        for g, j, u, v, u2, v2 in b:
            inner = max(0.0, min(x2, u2) - max(x, u)) * max(0.0, min(y2, v2) - max(y, v))
            if g == f and inner / (20 + 30 - inner) >= 0.4:
                found.append((-inner / (50 - inner), j))
        if found:
            want[i] = (min(found)[1], round(-min(found)[0], 9))
    assert got == want and len(want) > 20


def test_serves_make_their_windows_once(spark):
    """Poses are windowed once, into a table that suppression and result both read; what lies behind a row is not shuffled."""
    plan = planned(queries.queries()["serve_detection"](spark, SF))
    assert "collect_list(struct(ms" not in plan and "-1350" not in plan


def test_bouts_run_their_windows_once(spark):
    """Each pass over buckets reads its rows twice: what the bouts rest on is kept, not run again for each of them."""
    rows = [(1, i * 200, ("LIVE_SEED", "BETWEEN_POINTS", "UNKNOWN")[i % 7 % 3], i * 200, i * 200, None) for i in range(50)]
    states = spark.createDataFrame(rows, "match long, ms long, state string, evidence_start long, evidence_end long, between_start long")
    plan = planned(live.bouts(states, ["match"]))
    assert plan.count("Scan") <= 2 and "evidence_end" not in plan


def test_poses_are_windowed_before_any_join(spark):
    """Poses meet the frames of both ends as candidates only, and the serves' masks as rows of the timeline: they are shuffled once."""
    pose = _poses(spark, SF)
    plan = planned(motions.serve_candidates(pose, pose.select("match", "ms"), ["match"]))
    assert plan.index("Join Inner") < plan.index("-1350")
    assert "LeftOuter" not in planned(motions.stroke_proposals(pose, pose.select("match", "ms"), ["match"]))


def test_points_send_no_growing_side_through_the_driver(spark):
    ran = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: {x.executionId(): x for x in map(ran.executionsList().apply, range(ran.executionsCount()))}
    before = max(listed(), default=-1)
    queries.queries()["point_decoding"](spark, SF).write.format("noop").mode("overwrite").save()
    plans = [x.physicalPlanDescription() for i, x in listed().items() if i > before]
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
