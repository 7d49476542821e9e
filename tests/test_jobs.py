from pyspark.sql import functions as F

from tidemark.operators import jobs

SHAPE = "k int, e array<struct<id:int,action:string>>, d array<struct<stroke_episodes:array<struct<id:int,action:string>>,actions:array<struct<id:int,action:string>>>>"


def test_actions(spark):
    a, b, serve = (1, "stroke"), (2, None), (3, "serve")
    rows = [(1, [a, None], [([b], None)]), (2, [], [([b], None)]), (3, None, [([a, serve], [b]), None, (None, [a, b, serve, None]), (None, None)]), (4, None, None), (5, None, [])]
    out = spark.createDataFrame(rows, SHAPE).select("k", jobs.actions(F.col("e"), F.col("d")).alias("a"))
    assert {r.k: [x.id for x in r.a] for r in out.collect()} == {1: [1], 2: [], 3: [1, 3, 1, 2], 4: [], 5: []}


def test_admission(spark):
    rows = [(1, 2, 10, 0, 0), (2, 3, 10, 0, 0), (3, 2, 60, 40, 0), (4, 2, 10, 0, 5), (5, 0, 95, 0, 4)]
    out = jobs.admission(spark.createDataFrame(rows, "k int, jobs int, used int, reserved int, pending int"), 3, 100, 50, 5)
    assert [(r.verdict, r.reservation) for r in out.orderBy("k").collect()] == [("accepted", 50), ("jobs", None), ("bytes", None), ("queue", None), ("accepted", 5)]
