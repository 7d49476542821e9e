"""Tracks that are kept from batch to batch."""

import random

import pandas as pd

from tidemark.streaming import live, tracks


def boxes():
    """Three things that move through two videos, one of them away for a while, and some that appear once."""
    rng, rows = random.Random(5), []
    for video in (1, 2):
        for f in range(60):
            for thing in range(3):
                if thing == 2 and 20 <= f < 40:
                    continue
                x, y = 10.0 * thing * video + 0.2 * f, 20.0 * thing + rng.random()
                rows.append((video, f * 100, x, y, x + 5, y + 5))
            if rng.random() < 0.1:
                rows.append((video, f * 100, 500.0 + f * 10, 0.0, 503.0 + f * 10, 4.0))
    return rows


def brute(rows, least=0.3, rest=1000):
    """Frame by frame with all pairs, the best one first."""
    out = {}
    for video in {r[0] for r in rows}:
        known, number = {}, 0
        for ms in sorted({r[1] for r in rows if r[0] == video}):
            here = sorted(r[2:] for r in rows if r[:2] == (video, ms))
            known = {t: v for t, v in known.items() if ms - v[0] <= rest}
            free, done = dict(known), {}
            while True:
                best = max(((tracks.overlap(v[1], b), -t, -i) for t, v in free.items() for i, b in enumerate(here) if i not in done), default=(0,))
                if best[0] < least:
                    break
                done[-best[2]] = -best[1]
                free.pop(-best[1])
            for i, b in enumerate(here):
                if i not in done:
                    done[i], number = number, number + 1
                known[done[i]] = (ms, b)
                out[video, ms, *b] = done[i]
    return out


def test_small_batches_equal_one(spark, tmp_path):
    rows = boxes()
    data = pd.DataFrame(rows, columns=["video", "ms", *tracks.BOX])
    data["ts"] = pd.to_datetime(data["ms"] + 86_400_000, unit="ms")
    df = spark.createDataFrame(data)
    got = {tuple(r)[:-1]: r.track for r in tracks.tracks(df, "video").collect()}
    assert got == brute(rows) and max(got.values()) > 3
    for i, part in enumerate((data[data["ms"] < 1500], data[(data["ms"] >= 1500) & (data["ms"] < 3000)], data[data["ms"] >= 3000])):
        spark.createDataFrame(part.sample(frac=1, random_state=i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_available(tracks.tracks(stream, "video"), live.fenced_sink(str(tmp_path / "out"), "a", lambda: "a"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r)[:6]: r.track for r in found.drop("batch").collect()} == got
    assert found.select("batch").distinct().count() >= 3


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0), (1, 0, 0.0, 0.0, 1.0, 1.0), (1, None, 0.0, 0.0, 1.0, 1.0), (1, 100, None, 0.0, 1.0, 1.0), (1, 2000, 0.0, 0.0, 1.0, 1.0)], "video int, ms long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.ms, r.track) for r in tracks.tracks(df, "video").collect()) == [(0, 0), (0, 1), (2000, 2)]
    assert tracks.tracks(df.limit(0), "video").count() == 0
