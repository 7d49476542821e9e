"""Carried running values, and the automaton, the scan and the islands that rest on them, with one key that owns every row."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import evaluation, folds, islands, prefix, spatial


def test_carried_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(prefix, "FAN", 4)
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.randrange(9)])) for k in (1, 2, None) for t in rng.sample(range(600), 120)]
    df = spark.createDataFrame(rows, "k int, t long, x int")
    x = F.col("x")
    ask = dict(sums={"s": x}, lasts={"l": x}, maxes={"m": x}, before_sums={"bs": x}, befores={"bl": x}, before_maxes={"bm": x}, afters={"a": F.col("t")})
    for keys in (["k"], []):
        source = df if keys else df.groupBy("t").agg(F.max("x").alias("x"), F.max("k").alias("k"))
        got = {(r.k if keys else 0, r.t): r for r in prefix.carried(source, keys, F.floor(F.col("t") / 7), ["t"], **ask).collect()}
        plain = {(r.k if keys else 0, r.t): r for r in prefix.carried(source.withColumn("_one", F.lit(0)), keys or ["_one"], None, ["t"], **ask).collect()}
        assert len(got) == source.count() and all(tuple(got[p][c] for c in "s l m bs bl bm a".split()) == tuple(plain[p][c] for c in "s l m bs bl bm a".split()) for p in got)
        for key in {p[0] for p in got}:
            total, last, most = 0, None, None
            for p in sorted((p for p in got if p[0] == key), key=lambda p: p[1]):
                r = got[p]
                assert (r.bs, r.bl, r.bm) == (total, last, most)
                total, last, most = total + (r.x or 0), last if r.x is None else r.x, max((v for v in (most, r.x) if v is not None), default=None)
                assert (r.s, r.l, r.m) == (total, last, most)


def walk(rows, between, bridge):
    """The automaton, row by row: (start, end, live rows, source)."""
    out, now, pend = [], None, None
    for t, s, e0, e1, calm in rows:
        if now is None:
            if s == "LIVE_SEED":
                now, pend = [e0, e1, 1, t], None
        elif s in folds.LIVE:
            now, pend = [now[0], max(now[1], e1), now[2] + 1, t], None
        elif s == "BETWEEN_POINTS":
            pend = pend or (t, calm)
            if t - pend[0] >= between:
                out.append((now[0], max(now[0], pend[1]), now[2], "between"))
                now = None
        else:
            pend = None
            if t - now[3] > bridge:
                out.append((now[0], now[1], now[2], "unknown"))
                now = None
    if now:
        out.append((now[0], now[1], now[2], "timeline"))
    return [b for b in out if b[1] > b[0]]


def test_bouts_of_one_user_that_owns_every_row(spark):
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(3000):
        t += rng.choice([0.25, 0.5, 1.0])
        rows.append((1, i, t, rng.choice(["LIVE_SEED", "LIVE_SUPPORT", "LIVE_SUPPORT", *["BETWEEN_POINTS"] * 4, *["UNKNOWN"] * 3]), t - rng.random(), t + rng.random(), t - rng.random()))
    df = spark.createDataFrame(rows, "k int, i int, t double, s string, e0 double, e1 double, calm double").repartition(5)
    want = walk([r[2:] for r in rows], 1.0, 1.0)
    for bucket in (None, F.floor(F.col("t") / 10)):
        got = folds.bouts(df, ["k"], "t", "i", "s", 1.0, 1.0, "e0", "e1", "calm", bucket).collect()
        assert sorted((r.start, r.end, r.live_rows, r.end_source) for r in got) == sorted(want)
        assert all((r.transition is not None) == (r.end_source == "between") for r in got)
    assert {w[3] for w in want} >= {"between", "unknown"}


def test_turns_of_one_key(spark):
    rng = random.Random(9)
    for trial in range(6):
        times = sorted(rng.sample(range(400), 60))
        rows = [(1, i, t / 4, rng.choice(["near", "far", None] if trial % 2 else ["near", "far"])) for i, t in enumerate(times)]
        want, took, skipped, stopped, expected, last = rng.choice(["near", "far", None]), [], 0, False, None, 2.0
        expected = want
        for _, i, t, side in rows:
            if side is None or (not took and t <= 2.7) or stopped:
                continue
            if t - last > (4.5 if not took else 6.0):
                stopped = True
            elif expected is not None and side != expected:
                skipped += 1
            elif t > 2.7:
                took.append(i)
                last, expected = t, "far" if side == "near" else "near"
        df = spark.createDataFrame(rows, "k int, i int, t double, side string")
        for bucket in (None, F.floor(F.col("t") / 3)):
            found, went = folds.turns(df, ["k"], "t", "i", "side", F.lit(want).cast("string"), F.lit(2.0), 0.7, 4.5, 6.0, bucket)
            assert sorted(r.i for r in found.collect()) == took
            assert [(r.accepted, r.skipped, r.stopped) for r in went.collect()] == [(len(took), skipped, stopped)]


def test_islands_in_buckets_equal_whole_keys(spark):
    rng = random.Random(2)
    rows = [(k, float(s), float(s + rng.choice([0, 1, 5, 60])), i) for i, (k, s) in enumerate((rng.randrange(2), rng.randrange(900)) for _ in range(300))]
    df = spark.createDataFrame(rows, "k int, start double, end double, i int").dropDuplicates(["k", "start", "end"])
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(islands.coalesce_intervals(df, ["k"], slack=1), islands.coalesce_intervals(df, ["k"], slack=1, width=20))
    assert same(islands.coalesce_globally(df, 20.0), islands.coalesce_intervals(df.withColumn("o", F.lit(0)), ["o"]).drop("o"))
    few = df.dropDuplicates(["k", "start"])
    assert same(islands.layout(few, ["k"], 2.0), islands.layout(few, ["k"], 2.0, width=20).select(*islands.layout(few, ["k"], 2.0).columns))
    wide = few.withColumn("limit", F.lit(1000.0))
    assert same(islands.padded(wide, ["k"], 3.0, 2.0, "limit"), islands.padded(wide, ["k"], 3.0, 2.0, "limit", width=20))
    whole = islands.sessions(df, ["k"], "start", 9, "i", "end")
    assert same(whole, islands.sessions(df, ["k"], "start", 9, "i", "end", bucket=F.floor(F.col("start") / 20)))
    # Only rows of buckets of buckets come together in one task.
    plan = islands.coalesce_globally(df, 20.0)._jdf.queryExecution().executedPlan().toString()
    lone = re.findall(r"Exchange SinglePartition.*\n.*?(\w+)\(", plan)
    assert {x for x in lone} <= {"HashAggregate", "SortAggregate", "ObjectHashAggregate"}


def test_box_pairs_equal_brute_force(spark):
    rng = random.Random(4)

    def boxes(n):
        out = [(i, rng.randrange(2), float(x := rng.randrange(-50, 50)), float(y := rng.randrange(-50, 50)), x + rng.choice([0.0, 1.0, 8.0, 90.0, 0.3]), y + rng.choice([0.0, 2.0, 70.0])) for i in range(n)]
        return [*out, (n, 0, 5.0, 5.0, 4.0, 9.0), (n + 1, 0, None, 5.0, 6.0, 9.0), (n + 2, *out[0][1:])]

    a, b = boxes(120), boxes(90)
    left = spark.createDataFrame(a, "i int, f int, x double, y double, x2 double, y2 double")
    right = spark.createDataFrame(b, "j int, f int, u double, v double, u2 double, v2 double")
    got = [(r.i, r.j) for r in spatial.box_pairs(left, right, ["f"], ("x", "y", "x2", "y2"), ("u", "v", "u2", "v2")).collect()]
    whole = lambda r: None not in r and r[2] <= r[4] and r[3] <= r[5]
    want = [(r[0], s[0]) for r in a if whole(r) for s in b if whole(s) and r[1] == s[1] and r[2] <= s[4] and s[2] <= r[4] and r[3] <= s[5] and s[3] <= r[5]]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert spatial.box_pairs(left.limit(0), right.limit(0), ["f"], ("x", "y", "x2", "y2"), ("u", "v", "u2", "v2")).count() == 0


def test_matching_of_a_long_chain(spark):
    """Ten thousand intervals a side, each overlapping its two neighbours of the other side: one stretch, no single pairs."""
    n, rng = 10_000, random.Random(6)
    gold = [(1, i, i * 10.0, i * 10.0 + 10) for i in range(n)]
    predicted = [(1, i, i * 10.0 + 3 + rng.random() * 4, i * 10.0 + 13 + rng.random() * 4) for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "k int, id long, start double, end double")
    got = evaluation.matched(make(predicted), make(gold), ["k"], 0.05, 500.0).collect()
    iou = lambda p, g: (min(p[3], g[3]) - max(p[2], g[2])) / (max(p[3], g[3]) - min(p[2], g[2]))
    # Predictions i can take gold i or i + 1: along the chain, the best total is a matter of the last choice.
    best = {False: (0, 0.0), True: (-1, 0.0)}  # whether gold i is taken by prediction i - 1
    for i in range(n):
        after = {}
        for taken, (count, total) in best.items():
            if count < 0:
                continue
            for g, here in ((None, 0.0), (i, iou(predicted[i], gold[i])), (i + 1, iou(predicted[i], gold[i + 1]) if i + 1 < n else 0.0)):
                if g is not None and (here < 0.05 or (g == i and taken)):
                    continue
                option = (count + (g is not None), total + here)
                key = g == i + 1
                after[key] = max(after.get(key, (-1, 0.0)), option)
        best = {False: (-1, 0.0), True: (-1, 0.0), **after}
    count, total = max(best.values())
    assert len(got) == count and abs(sum(r.iou for r in got) - total) < 1e-6


def test_leaders(spark):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randrange(20)), float(rng.randrange(20)), rng.choice([1.0, 2.0, 3.0])) for k in range(5) for i in range(25)] + [(0, 99, None, 1.0, 9.0)]
    got = sorted(map(tuple, folds.leaders(spark.createDataFrame(rows, "k int, i int, x double, y double, s double"), ["k"], ["x", "y"], "s", "i", 6.0, 4).collect()))
    want = []
    for k in range(5):
        kept = []
        for _, i, x, y, _ in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: (-r[4], r[1])):
            if len(kept) < 4 and all((x - a) ** 2 + (y - b) ** 2 > 36 for _, a, b in kept):
                kept.append((i, x, y))
        want += [(k, i, n + 1) for n, (i, _, _) in enumerate(kept)]
    assert got == sorted(want)
