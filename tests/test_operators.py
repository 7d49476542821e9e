"""Edge cases of the operators, on small tables."""

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, intervals, vectors
from tidemark.operators import bookkeeping, evaluation, folds, islands, ranges, timeline
from tidemark.sources import intervals as sources
from tidemark.streaming import live


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_session_gap_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 21, 3)], "k int, t long, i long")
    assert sorted(rows(islands.sessions(df, ["k"], "t", 10, "i").select("start", "end", "n"))) == [(0, 10, 2), (21, 21, 1)]


def test_touching_intervals_merge_and_short_ones_go(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 5.0, 5.05), (1, 9.0, 8.0), (1, 1.5, 1.6)], "k int, start double, end double")
    assert rows(islands.coalesce_intervals(df, ["k"], min_length=0.06).select("start", "end", "parts")) == [(0.0, 2.0, 3)]
    assert rows(islands.union_length(df, ["k"]).select("covered"))[0][0] == pytest.approx(2.05)
    assert sorted(rows(islands.coalesce_globally(df.select("start", "end"), 1.2).select("start", "end", "parts"))) == [(0.0, 2.0, 3), (5.0, 5.05, 1)]


def test_padding_collides_in_proportion(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 100.0), (1, 24.0, 30.0, 100.0), (1, 29.0, 99.0, 100.0)], "k int, start double, end double, limit double")
    out = sorted(rows(islands.padded(df, ["k"], 3.0, 3.0, "limit").select("start", "padded_start", "padded_end")))
    assert out == [(10.0, 7.0, 22.0), (24.0, 22.0, 30.0), (29.0, 29.0, 100.0)]


def test_nms_distance_equal_to_radius_keeps_both(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 10, 1.0, 2), (1, 19, 5.0, 3), (1, 5, 0.5, 4)], "k int, t long, s double, i long")
    assert sorted(r[0] for r in rows(folds.suppressed(df, ["k"], "t", "s", "i", 10).select("i"))) == [1, 3]
    assert sorted(r[0] for r in rows(folds.suppressed(df, ["k"], "t", "s", "i", 9).select("i"))) == [1, 2, 3]


def automaton(states):
    return [(1, float(t), i, s) for i, (t, s) in enumerate(states)]


BOUTS = [
    [(0, "LIVE_SEED"), (1, "LIVE_SUPPORT"), (2, "BETWEEN_POINTS"), (3, "BETWEEN_POINTS")],
    [(0, "LIVE_SEED"), (0.5, "BETWEEN_POINTS"), (0.9, "UNKNOWN"), (1.2, "BETWEEN_POINTS"), (2.1, "LIVE_SUPPORT"), (4, "UNKNOWN")],
    [(0, "LIVE_SEED"), (1, "UNKNOWN"), (1.2, "LIVE_SEED"), (2.2, "UNKNOWN"), (2.3, "UNKNOWN"), (9, "LIVE_SUPPORT")],
    [(0, "LIVE_SUPPORT"), (1, "LIVE_SEED"), (2, "LIVE_SUPPORT")],
    [(0, "LIVE_SEED"), (5, "UNKNOWN")],
]
ENDS = [[(0, 2, 2, "between")], [(0, 2.1, 2, "unknown")], [(0, 1.2, 2, "unknown")], [(1, 2, 2, "timeline")], []]


@pytest.mark.parametrize("states, want", list(zip(BOUTS, ENDS, strict=True)))
def test_bouts(spark, states, want):
    df = spark.createDataFrame(automaton(states), "k long, t double, i int, s string")
    assert rows(folds.bouts(df, ["k"], "t", "i", "s", 1.0, 1.0).select("start", "end", "live_rows", "end_source")) == want
    bout = live._Bout(None, 1.0, 1.0)
    done = [x for x in (bout.step(t, s) for t, s in states) if x]
    if bout.start is not None and (x := bout.close(bout.last, "timeline")):
        done.append(x)
    assert done == want


def test_alternating_scan_skips_and_stops(spark):
    data = [(1, t, i, s) for i, (t, s) in enumerate([(0.5, 0), (1.0, 1), (2.0, 0), (3.0, 0), (4.0, 1), (11.0, 0), (11.5, 0)])]
    df = spark.createDataFrame(data, "k int, t double, i long, s int")
    out = folds.alternating_scan(df, ["k"], "t", "i", "s", F.lit(0), F.lit(0.0), 0.5, 5.0).collect()[0]
    assert (list(out.accepted), out.skipped, out.stopped) == ([2, 4], 2, True)


def test_asof_equals_pandas(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": rng.integers(0, 1000, 300), "i": range(300)})
    s = pd.DataFrame({"k": rng.integers(0, 2, 80), "t": rng.integers(100, 900, 80), "v": rng.random(80)}).sort_values("v").drop_duplicates(["k", "t"], keep="last")
    out = ranges.asof(spark.createDataFrame(p), spark.createDataFrame(s), ["k"], "t", "v", 37).toPandas().sort_values("i")
    want = pd.merge_asof(p.sort_values("t"), s.sort_values("t"), on="t", by="k").sort_values("i")
    ahead = pd.merge_asof(p.sort_values("t"), s.sort_values("t"), on="t", by="k", direction="forward").sort_values("i")
    assert out["prev_value"].fillna(-1).tolist() == want["v"].fillna(-1).tolist()
    assert out["next_value"].fillna(-1).tolist() == ahead["v"].fillna(-1).tolist()


def test_interpolation_prefers_the_earlier(spark):
    df = spark.createDataFrame([(5, 0, 1.0, 10, 3.0), (5, 0, 1.0, 16, 3.0), (5, None, None, 9, 3.0), (5, 5, 7.0, 5, 7.0), (5, None, None, None, None)], "t int, prev_time int, prev_value double, next_time int, next_value double")
    assert rows(ranges.interpolated(df, "t", 10).select("value_at", "how", "nearest_time")) == [(2.0, "blend", 0), (1.0, "prev", 0), (3.0, "next", 9), (7.0, "exact", 5), (None, "none", None)]


def test_band_bounds(spark):
    serves = spark.createDataFrame([(1, 0.0), (2, 100.0)], "id int, t double").withColumn("k", F.lit(1))
    hits = spark.createDataFrame([(0.7,), (104.5,)], "hit double").withColumn("k", F.lit(1))
    found = ranges.band_semi(serves, "id", hits, ["k"], "hit", F.col("t") + 0.7, F.col("t") + 4.5, 4.0, open_low=True)
    assert [r.id for r in found.collect()] == [2]


def test_overlap_pairs_equal_nested_loop(spark):
    rng = np.random.default_rng(1)
    make = lambda p: [(1, i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 90, 40), rng.integers(0, 30, 40)))]
    a, b = make("a"), make("b")
    pairs = ranges.overlap_pairs(spark.createDataFrame(a, "k int, a_id int, a_start double, a_end double"), spark.createDataFrame(b, "k int, b_id int, b_start double, b_end double"), ["k"], 7.0)
    assert sorted(rows(pairs.select("a_id", "b_id"))) == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])


def test_best_assignment_equals_permutations():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (3, 3), (2, 4), (5, 3), (4, 4)):
        for _ in range(20):
            gain = rng.random(shape).round(2) * (rng.random(shape) < 0.7)
            edges = [[(j, float(g)) for j, g in enumerate(row) if g > 0] for row in gain]
            pairs = evaluation.best_assignment(edges, shape[1])
            small, big = min(shape), max(shape)
            g = gain if shape[0] <= shape[1] else gain.T
            best = max(sum(g[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(gain[i, j] > 0 for i, j in pairs)
            assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_matching_prefers_more_pairs(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 8.0, 20.0)], "k int, id long, start double, end double")
    g = spark.createDataFrame([(1, 1, 0.0, 11.0), (1, 2, 7.0, 30.0)], "k int, id long, start double, end double")
    assert sorted(rows(evaluation.matched(p, g, ["k"], 0.3, 5.0).select("pred_id", "gold_id"))) == [(1, 1), (2, 2)]
    counts = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 0, 1), (1, 2, 1)], "m int, p int, g int")
    got = [tuple(r) for r in counts.select(*evaluation.scores(F.col("m"), F.col("p"), F.col("g")).values()).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.5, 1.0, pytest.approx(2 / 3))]


def test_geometry(spark):
    one = spark.range(1)
    c = lambda *x: [F.lit(float(v)) for v in x]
    cross = one.select(*geometry.line_crossing(c(0, 0, 10, 0), c(5, -5, 5, 5)), *geometry.line_crossing(c(0, 0, 1, 1), c(1, 0, 2, 1))).first()
    assert tuple(cross) == (5.0, 0.0, None, None)
    corners = [(250, 850), (1050, 850), (900, 320), (400, 320)]
    there = geometry.solve_homography([(0, 0), (10.97, 0), (10.97, 23.77), (0, 23.77)], corners)
    back = geometry.solve_homography(corners, [(0, 0), (10.97, 0), (10.97, 23.77), (0, 23.77)])
    for x, y in ((2.1, 3.4), (5.485, 11.885), (8.7, 19.2)):
        u, v = one.select(*geometry.project(there, *c(x, y))).first()
        assert tuple(one.select(*geometry.project(back, *c(u, v))).first()) == pytest.approx((x, y), abs=1e-6)
    assert one.select(geometry.joint_angle(*c(1, 0, 0, 0, 0, 1)), geometry.joint_angle(*c(0, 0, 0, 0, 0, 1))).first()[:] == (pytest.approx(90.0), None)
    assert one.select(intervals.interval_iou(*c(0, 10, 5, 15))).first()[0] == pytest.approx(1 / 3)
    assert one.select(vectors.cosine(F.array(*c(0, 0)), F.array(*c(1, 0)))).first()[0] == 0.0


def test_enrolment_and_collapse(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 0), (None, 1, 1), (None, 2, 0)], "k int, t int, v int")
    assert sorted(rows(timeline.enrolled(df, ["k"], "t", "v", F.col("v") == 1).select("k", "t")), key=str) == sorted([(1, 1), (1, 2), (None, 1)], key=str)
    near = spark.createDataFrame([(1, 0.0, 0), (1, 0.03, 1), (1, 0.07, 2)], "k int, t double, i int")
    assert [r.i for r in timeline.collapse_near(near, ["k"], "t", "i", 0.04).orderBy("i").collect()] == [1, 2]


def test_bookkeeping(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "id int, v string, version int")
    assert sorted(rows(bookkeeping.upserted(base, new, ["id"], "version").select("id", "v"))) == [(1, "c"), (2, "b"), (3, "e")]


def test_sources(spark, tmp_path):
    for name, doc in (("a", {"segments": [{"start": 5, "end": 6}, {"start": 1.5, "end": 2}]}), ("b", [[0, 1]]), ("c", []), ("d", [{"start": 1, "end": 2}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert [(r.file[-6], r.start, r.end) for r in sources.read_intervals(spark, str(tmp_path)).collect()] == [("a", 1.5, 2.0), ("a", 5.0, 6.0), ("b", 0.0, 1.0), ("d", 1.0, 2.0)]
    (tmp_path / "e.json").write_text("[[3, 2]]")
    (tmp_path / "f.json").write_text("{nope")
    assert sources.read_intervals(spark, str(tmp_path), strict=False).count() == 4
    with pytest.raises(Exception, match="0 <= start|no intervals"):
        sources.read_intervals(spark, str(tmp_path)).collect()
    probe = {"format": {"duration": "0"}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 4, "height": 3, "avg_frame_rate": "30000/1001", "duration": "7.5"}]}
    got = sources.media_info(spark.createDataFrame([("x", json.dumps(probe)), ("y", "{}")], "path string, json string")).collect()
    assert (got[0].duration_s, got[0].has_audio, got[0].width) == (7.5, True, 4) and got[0].fps == pytest.approx(29.97, abs=0.01)
    assert (got[1].duration_s, got[1].fps, got[1].has_audio) == (0.0, 0.0, False)
    grid = sources.time_grid(spark.createDataFrame([(1.0,), (0.0,)], "d double"), "d", 2.0)
    assert [r.time_s for r in grid.collect()] == [0.0, 0.5]
    files = spark.createDataFrame([("/x/input_1.mp4",), ("/x/res_1.txt",), ("/x/input_2.mp4",), ("/x/input_2.mov",), ("/x/res_2.txt",)], "path string")
    assert [r.id for r in sources.datasets(files).collect()] == ["1"]
    assert rows(spark.range(1).select(F.to_json(sources.points_of(F.lit("1,2;3,4")))))[0][0] == '[{"x":1.0,"y":2.0},{"x":3.0,"y":4.0}]'


def test_streaming_bouts_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    kinds = ["LIVE_SEED", "LIVE_SUPPORT", "BETWEEN_POINTS", "UNKNOWN"]
    data = pd.DataFrame({"event_id": range(400), "k": rng.integers(0, 5, 400), "t": np.sort(rng.integers(0, 10**9, 400)) * 1.0, "state": rng.choice(kinds, 400)})
    data["ts"] = pd.to_datetime(data["t"], unit="us")
    for i in range(4):
        part = data.iloc[i * 100 : (i + 1) * 100]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    want = folds.bouts(df, ["k"], "t", "event_id", "state", 2e7, 6e7)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = live.bouts(stream, "k", "t", "event_id", "state", 2e7, 6e7, "1 hour", 3_600_000)
    live.run_available(found, live.fenced_sink(str(tmp_path / "out"), "a", lambda: "a"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "start", "end", "live_rows", "end_source")
    closed = want.filter("end_source != 'timeline'").select("k", "start", "end", "live_rows", "end_source")
    assert sorted(rows(got)) == sorted(rows(closed))
    live.fenced_sink(str(tmp_path / "late"), "old", lambda: "new")(df, 0)
    assert not (tmp_path / "late").exists()
