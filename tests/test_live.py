"""Live windows against a plain recount of each window, from the rules as written in the docstrings."""

import random
from statistics import median

from tidemark.plans import live

ENDS = ("near", "far")
FAR = {"near": "far", "far": "near"}


def brute(players, serves, strokes):
    """State and evidence of every frame: each window is recounted from nothing."""
    c, frames = live.Evidence(), {}
    for ms, actor, end, ready, wrist, court in players:
        arm = (wrist or 0) >= c.arm_speed
        frames.setdefault(ms, []).append({"end": end, "ready": bool(ready), "arm": arm, "active": arm or bool(ready) and (court or 0) >= c.court_speed, "wrist": wrist or 0})
    has = lambda ms, what, end: any(p[what] for p in frames[ms] if p["end"] == end)
    two = {ms for ms, p in frames.items() if len(p) >= 2 and {x["end"] for x in p} == set(ENDS)}
    relaxed = {ms for ms in two if sum(x["ready"] for x in frames[ms]) / len(frames[ms]) <= c.relaxed_ready and median(x["wrist"] for x in frames[ms]) <= c.relaxed_wrist}
    events = sorted([(ms, "serve", a, e if e in FAR else None) for ms, a, e in serves] + [(ms, "stroke", a, e if e in FAR else None) for ms, a, e in strokes])
    out = {}
    for t in frames:
        low, high = t - c.half, t + c.half
        near = [ms for ms in frames if low <= ms <= high]
        local = [e for e in events if low <= e[0] <= high]
        pairs = sum(1 for a, b in zip(local, local[1:]) if a[3] and b[3] and a[3] != b[3] and c.answer_from <= b[0] - a[0] <= c.answer_to)
        answered = 0
        for e in local:
            if e[3]:
                span = [ms for ms in near if e[0] + c.answer_from <= ms <= e[0] + c.answer_to]
                answered += any(has(ms, "active", FAR[e[3]]) for ms in span) or sum(has(ms, "ready", FAR[e[3]]) for ms in span) >= 2
        share = {}
        for end in ENDS:
            seen = [ms for ms in near if any(p["end"] == end for p in frames[ms])]
            share[end] = [sum(has(ms, what, end) for ms in seen) / max(1, len(seen)) for what in ("ready", "active")]
        two_share, calm_share = len(two & {*near}) / len(near), len(relaxed & {*near}) / len(near)
        sided = two_share >= c.two_sided
        reasons = [n for n, yes in (("serve", any(e[1] == "serve" for e in local)), ("alternating_pair", pairs), ("answered_stroke", answered and any(e[1] == "stroke" for e in local))) if yes]
        support = sided and all(share[e][0] >= c.end_ready for e in ENDS) and (all(share[e][1] >= c.end_active for e in ENDS) or local or answered)
        between = sided and calm_share >= c.relaxed and not local and not answered
        times = [e[0] for e in local] + [ms for ms in near if any(p["ready"] or p["arm"] for p in frames[ms])]
        state = "LIVE_SEED" if reasons else "LIVE_SUPPORT" if support else "BETWEEN_POINTS" if between else "UNKNOWN"
        calm = min(relaxed & {*near}) if between else None
        out[t] = (state, reasons, len(near), pairs, answered, min(times, default=None), max(times, default=None), calm, [round(x, 9) for e in ENDS for x in share[e]])
    return out


def match(rng, players):
    speed = lambda: rng.choice([None, 0.0, 0.3, 0.54996, 0.56, 2.0])
    rows = {}
    for ms in range(0, 40_000, 166):
        calm = rng.random() < (0.95 if ms % 20_000 > 9_000 else 0.3)
        for p in range(players):
            if rng.random() < 0.9:
                rows[ms, p] = (ms, p, rng.choice(["other", None]) if rng.random() < 0.02 else ENDS[p % 2], not calm and rng.random() < 0.6, 0.1 if calm else speed(), 0.1 if calm else speed())
    event = lambda: (rng.randrange(40) * 1000 + rng.choice([0, 166, 500]), rng.randrange(players), rng.choice([*ENDS, *ENDS, None, "x"]))
    return list(rows.values()), list({event() for _ in range(rng.choice([0, 2]))}), list({event() for _ in range(rng.choice([0, 3, 12]))})


def rounded(players):
    """Speeds as they are kept, with four decimals."""
    return [(*p[:4], *(None if x is None else round(x, 4) for x in p[4:])) for p in players]


def test_windows_equal_recount(spark):
    rng = random.Random(12)
    matches = {m: match(rng, 2 + 2 * (m % 2)) for m in range(6)}
    who = spark.createDataFrame([(m, *p) for m, x in matches.items() for p in x[0]], "m int, ms long, actor_id int, end string, ready boolean, wrist_speed double, court_speed double")
    acts = [spark.createDataFrame([(m, *e) for m, x in matches.items() for e in x[i]], "m int, ms long, actor_id int, end string") for i in (1, 2)]
    # Buckets of three seconds: most windows and pairs reach over a border.
    seen = live.frames(who, ["m"])
    events = live.answers(live.numbered(*acts, ["m"], bucket=3000), seen, ["m"])
    got = live.windows(seen, events, ["m"], bucket=3000).collect()
    assert {r.state for r in got} == {"LIVE_SEED", "LIVE_SUPPORT", "BETWEEN_POINTS", "UNKNOWN"}
    for m, (players, serves, strokes) in matches.items():
        want = brute(rounded(players), serves, strokes)
        mine = {r.ms: (r.state, r.seed_reasons, r.n_frames, r.n_pairs, r.n_answers, r.evidence_start, r.evidence_end, r.between_start, [round(x, 9) for x in (r.near_ready_share, r.near_active_share, r.far_ready_share, r.far_active_share)]) for r in got if r.m == m}
        assert mine.keys() == want.keys()
        assert all(mine[t] == want[t] for t in want), next((t, mine[t], want[t]) for t in want if mine[t] != want[t])
    wide = live.windows(seen, events, ["m"], bucket=10**9)
    assert wide.exceptAll(live.windows(seen, events, ["m"], bucket=3000)).count() == 0
    one = live.actor_evidence(who, wide.filter("m = 1 and ms = 1660"), ["m"]).collect()
    mine = [p for p in matches[1][0] if 660 <= p[0] <= 2660]
    assert {(r.end, r.actor_id): (r.observed, r.ready, r.arm_active) for r in one} == {(e, a): (sum(1 for p in mine if p[1:3] == (a, e)), sum(bool(p[3]) for p in mine if p[1:3] == (a, e)), sum(round(p[4] or 0, 4) >= 0.55 for p in mine if p[1:3] == (a, e))) for e, a in {(p[2], p[1]) for p in mine}}


def test_frames_without_players_and_empty_tables(spark):
    schema = "m int, ms long, actor_id int, end string, ready boolean, wrist_speed double, court_speed double"
    who = spark.createDataFrame([(1, 0, 1, "near", True, 0.1, 0.1), (1, 0, 1, "near", True, 0.1, 0.1), (1, None, 2, "far", True, 0.1, 0.1)], schema)
    times = spark.createDataFrame([(1, 0), (1, 166), (1, 166)], "m int, ms long")
    rows = {r.ms: r for r in live.frames(who, ["m"], times=times).collect()}
    assert rows[0].visible == 1 and rows[166].visible == 0 and not rows[166].two_sided and not rows[166].near_seen
    none = spark.createDataFrame([], "m int, ms long, actor_id int, end string")
    events = live.answers(live.numbered(none, none, ["m"]), live.frames(who, ["m"]), ["m"])
    assert [r.state for r in live.windows(live.frames(who, ["m"]), events, ["m"]).collect()] == ["UNKNOWN"]
    assert live.windows(live.frames(who.limit(0), ["m"]), events, ["m"]).count() == 0
