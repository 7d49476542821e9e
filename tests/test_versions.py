"""Versions under writers whose steps interleave."""

import threading

import pytest

from tidemark.sources import versions

SEGMENTS, POINTS = "match int, start double, end double", "match int, no int"


def first(spark, root):
    tables = {"segments": spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 2.0)], SEGMENTS), "points": spark.createDataFrame([(1, 0), (2, 0)], POINTS)}
    return versions.publish(spark, root, versions.prepare(root, tables), 0)


def test_two_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    assert versions.latest(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "segments")
    assert first(spark, root) == 1
    one = versions.prepare(root, {"segments": spark.createDataFrame([(3, 0.0, 1.0)], SEGMENTS), "points": spark.createDataFrame([], POINTS)})
    two = versions.prepare(root, {"segments": spark.createDataFrame([(4, 0.0, 1.0)], SEGMENTS), "points": spark.createDataFrame([(4, 0)], POINTS)})
    held = versions.read(spark, root, "segments")  # a reader that resolved version 1
    assert versions.publish(spark, root, two, 1) == 2
    with pytest.raises(versions.Stale):
        versions.publish(spark, root, one, 1)
    assert versions.publish(spark, root, two, 1) == 2  # a retry of what is published
    assert {r.match for r in versions.read(spark, root, "segments").collect()} == {4}
    assert {r.match for r in held.collect()} == {1, 2} == {r.match for r in versions.read(spark, root, "points", 1).collect()}
    assert versions.publish(spark, root, one, versions.latest(spark, root)) == 3


def test_many_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    first(spark, root)
    attempts = [versions.prepare(root, {"segments": spark.createDataFrame([(i, 0.0, 1.0)], SEGMENTS), "points": spark.createDataFrame([(i, 0)], POINTS)}) for i in range(4)]
    won = []

    def write(attempt):
        while True:
            try:
                won.append((versions.publish(spark, root, attempt, versions.latest(spark, root)), attempt))
                return
            except versions.Stale:
                pass

    threads = [threading.Thread(target=write, args=(a,)) for a in attempts]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert sorted(v for v, _ in won) == [2, 3, 4, 5] and all(versions.resolve(spark, root, v) == a for v, a in won)


def test_writers_of_one_version_at_once(spark, tmp_path):
    def write(root, attempt, start, won):
        start.wait()
        try:
            won.append((versions.publish(spark, root, attempt, 0), attempt))
        except versions.Stale:
            pass

    for turn in range(40):
        root, won, start = f"file://{tmp_path}/{turn}", [], threading.Barrier(8)
        threads = [threading.Thread(target=write, args=(root, f"{i:032x}", start, won)) for i in range(8)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        assert len(won) == 1 and versions.resolve(spark, root, 1) == won[0][1]


def test_an_unwritten_pointer_is_no_version(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    first(spark, root)
    (tmp_path / "c" / "versions" / "000000000002").touch()
    assert versions.latest(spark, root) == 1 and versions.read(spark, root, "points").count() == 2


def test_segment_edits_are_versions(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    first(spark, root)
    edits = spark.createDataFrame([(1, 3.0, 4.0), (1, 4.0, 6.0), (1, 0.0, 0.05), (5, 0.0, 2.0)], SEGMENTS)
    assert versions.edit_segments(spark, root, edits, 1) == 2
    assert sorted(map(tuple, versions.read(spark, root, "segments").collect())) == [(1, 3.0, 6.0), (2, 1.0, 2.0), (5, 0.0, 2.0)]
    assert [tuple(r) for r in versions.read(spark, root, "points").collect()] == [(2, 0)]
    assert versions.read(spark, root, "points", 1).count() == 2
    with pytest.raises(versions.Stale):
        versions.edit_segments(spark, root, edits, 1)
