import pytest
from pyspark.sql import functions as F

from tidemark.functions import pose
from tidemark.operators import roster


def test_rosters(spark):
    old = spark.createDataFrame([(1, "P1", " Ann ", "T1"), (1, "P2", " ", "T2"), (2, "P1", "Bo", "T1")], "m int, id string, name string, team string")
    new = spark.createDataFrame([(1, "P1", "P1", "T9"), (1, "P2", "P2", "T2")], "m int, id string, name string, team string")
    assert sorted(map(tuple, roster.merged_profiles(old, new, "m").collect())) == [(1, "P1", "Ann", "T9"), (1, "P2", "P2", "T2"), (2, "P1", "Bo", "T1")]
    same = {r.m: r.same for r in roster.same_members(old, new, ["m"], "id").collect()}
    assert same == {1: True, 2: False}
    tracks = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    listed = spark.createDataFrame([(1, "A", 0), (1, "B", 1)], "t int, actor string, order int")
    given = spark.createDataFrame([(1, "X"), (2, "Y")], "t int, actor string")
    assert [(r.t, r.actor) for r in roster.actors(tracks, listed, given, "t").orderBy("t").collect()] == [(1, "B"), (2, "Y"), (3, None)]


def test_consensus_and_picks(spark):
    rows = [(1, 1, [0.0, 0.0, 1.0, 1.0], 0.5), (1, 2, [0.1, 0.0, 1.0, 1.2], 0.6), (1, 3, [0.0, 0.1, 1.1, 1.0], 0.4), (1, 4, [9.0, 9.0, 9.0, 9.0], 0.9)]
    df = spark.createDataFrame(rows, "k int, i int, p array<double>, s double")
    got = roster.consensus(df, ["k"], "i", "p", "s", 1.0).first()
    assert got.support == 3 and got.p == pytest.approx([0.0, 0.0, 1.0, 1.0])
    assert [r.i for r in roster.clear_best(df, ["k"], "s", "i", 0.2).collect()] == [4]
    assert roster.clear_best(df, ["k"], "s", "i", 0.4).count() == 0
    sides = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 4, 2), (1, 1, 3, 3), (2, 0, 1, 4)], "k int, side int, area int, i int")
    assert sorted(r.i for r in roster.top_per_side(sides, ["k"], "side", F.col("area"), "i", 1).collect()) == [1, 3]


def test_pose(spark):
    points = [[0.0, 0.0]] * 5 + [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, -1.0], [0.0, 2.0], [1.0, 2.0], [0.0, 3.0], [1.0, 3.0], [0.0, 4.0], [1.0, 4.0]]
    sure = [1.0] * 17
    blind = [0.1] * 17
    df = spark.createDataFrame([(1, points, sure), (2, points, blind)], "i int, p array<array<double>>, c array<double>")
    x, y = pose.wrist(F.col("p"), F.col("c"), "right")
    out = df.select(pose.elbow_angle(F.col("p"), F.col("c"), "left"), pose.knee_angle(F.col("p"), F.col("c")), pose.usable(F.col("c")), pose.ready(F.col("p"), F.col("c")), y, pose.raised_hand(F.col("p"), F.col("c"))).collect()
    assert tuple(out[0]) == (pytest.approx(90.0), pytest.approx(180.0), True, False, pytest.approx(-0.5), "right")
    assert tuple(out[1]) == (None, None, False, False, None, None)
