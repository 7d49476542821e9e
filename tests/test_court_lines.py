"""Corners from lines, and the court that is told from its neighbours."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import court_lines


def test_corners_are_of_the_extreme_lines(spark):
    lines = [(1, 0, 800, 1200, 800), (1, 0, 300, 1200, 300), (1, 0, 500, 1200, 510), (1, 200, 0, 350, 1000), (1, 1000, 0, 850, 1000), (1, 5, 5, 5, 5), (2, 0, 800, 1200, 800), (2, 200, 0, 350, 1000), (2, None, 0, 1, 1)]
    df = spark.createDataFrame([(k, *(None if x is None else float(x) for x in r)) for k, *r in lines], "k int, x1 double, y1 double, x2 double, y2 double")
    (r,) = court_lines.outer_corners(df, ["k"]).collect()
    assert (r.near_left_x, r.near_left_y) == pytest.approx((320, 800)) and (r.near_right_x, r.far_left_x) == pytest.approx((880, 245))
    assert court_lines.outer_corners(df.limit(0), ["k"]).count() == 0


def test_neighbouring_courts_are_not_plausible(spark):
    rows = [(-3.2, 978.95, 1808.18, 924.06, 1079.03, 680.44, 858.65, 673.71), (-113.0, 762.0, 1960.0, 709.0, 1469.0, 453.0, 861.0, 427.0), (166.0, 919.0, 2020.0, 914.0, 1104.0, 681.0, 859.0, 674.0)]
    names = [f"{c}_{a}" for c in court_lines.CORNERS for a in "xy"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    corner = {c: (F.col(f"{c}_x"), F.col(f"{c}_y")) for c in court_lines.CORNERS}
    assert [r[0] for r in df.select(court_lines.plausible(F.lit(1920.0), F.lit(1080.0), corner)).collect()] == [True, False, False]


def test_lines_support_by_direction_place_and_extent(spark):
    expected = spark.createDataFrame([(1, i, 0.0, 100.0 * i, 100.0, 100.0 * i) for i in range(5)], "k int, no int, x1 double, y1 double, x2 double, y2 double")
    seen = [(1, 90.0, 2.0, 20.0, -2.0), (1, 0.0, 100.0, 30.0, 100.0), (1, 0.0, 220.0, 100.0, 220.0), (1, 50.0, 250.0, 50.0, 350.0), (1, 0.0, 400.0, 60.0, 400.0), (2, 0.0, 100.0, 100.0, 100.0)]
    found = court_lines.supported(expected, spark.createDataFrame(seen, "k int, u1 double, v1 double, u2 double, v2 double"), ["k"], "no", 10.0, 5.0, 0.5, 20.0)
    assert sorted(r.no for r in found.collect()) == [0, 4]
    assert court_lines.model_lines(spark).filter("y1 = y2").count() == 5


def test_labels_are_checked_and_exported(spark):
    import json

    from tidemark.operators import labelling

    rows = [(1, "a", "player_identity", "player", "P1"), (1, "a", "player_identity", "player", "P9"), (1, "a", "player_identity", "quality", "clear"), (1, "a", "player_identity", "notes", ""), (1, "b", "serve_motion", "server", "unknown"), (1, "b", "serve_motion", "end", None), (1, "b", "serve_motion", "notes", " x "), (1, "b", "serve_motion", "notes", "x" * 1001), (2, "c", "serve_motion", "server", "P1"), (2, "c", "serve_motion", "end", "left")]
    values = spark.createDataFrame(rows, "job int, task string, kind string, field string, value string")
    roster = spark.createDataFrame([(1, "P1", "Ann"), (1, "P1", "Ann")], "job int, id string, name string")
    got = {(r.job, r.field, r.value): (r.clean, r.error) for r in labelling.checked_labels(values, roster).collect()}
    assert got == {(1, "player", "P1"): ("P1", None), (1, "player", "P9"): (None, "unknown_value"), (1, "quality", "clear"): ("clear", None), (1, "notes", ""): (None, "unknown_field"), (1, "server", "unknown"): ("unknown", None), (1, "end", None): (None, None), (1, "notes", " x "): ("x", None), (1, "notes", "x" * 1001): (None, "long_note"), (2, "server", "P1"): (None, "unknown_value"), (2, "end", "left"): (None, "unknown_value")}
    jobs = spark.createDataFrame([(1, "m.mp4", "{}"), (2, "n.mp4", None), (3, "o.mp4", "{}")], "job int, filename string, context string")
    tasks = spark.createDataFrame([(1, "b", "serve_motion", 2.0), (1, "a", "player_identity", 1.0)], "job int, task string, kind string, time_s double")
    docs = {r.job: json.loads(r.document) for r in labelling.exported(jobs, roster.distinct(), tasks, labelling.checked_labels(values, roster)).collect()}
    assert docs.keys() == {1, 3} and docs[3]["tasks"] == [] and [t["task"] for t in docs[1]["tasks"]] == ["a", "b"]
    assert [(x["task"], x["field"], x["clean"]) for x in docs[1]["labels"]] == [("a", "player", "P1"), ("a", "quality", "clear"), ("b", "notes", "x"), ("b", "server", "unknown")]


def test_names_and_calibrations(spark, tmp_path):
    from tidemark.functions import names
    from tidemark.sources import intervals

    cases = {"a/b/c d.mp4": "c d.mp4", "x/": "x", None: "upload.mp4", "..": "upload.mp4", "é#1?.mov": "é_1_.mov", " .hid": "hid"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.s for r in df.select("n", names.safe_name(F.col("n")).alias("s")).collect()} == cases
    ids = spark.createDataFrame([("P1",), ("-a",), ("a" * 51,), (None,)], "n string")
    assert [r[0] for r in ids.select(names.is_roster_id(F.col("n"))).collect()] == [True, False, False, False]
    corners = spark.createDataFrame([("one", [(1.0, 2.0), (3.0, 4.0)])], "name string, corners array<struct<x double, y double>>")
    intervals.write_calibrations(corners, str(tmp_path / "cal"))
    (r,) = intervals.calibrations(spark, str(tmp_path / "cal" / "name=one")).collect()
    assert [(p.x, p.y) for p in r.corners] == [(1.0, 2.0), (3.0, 4.0)]
