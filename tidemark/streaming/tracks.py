"""Boxes of a stream linked into tracks: what a key's live tracks are is kept from batch to batch.

A frame's boxes take the live tracks that they overlap most, the best pair first; a box that is left over begins a track. What a
batch gives depends on the rows so far only, so a stream in small batches and one batch of everything give the same tracks, as long as no frame
is cut in two and rows do not come after later frames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BOX = ("x0", "y0", "x1", "y1")


def overlap(a: list[float], b: list[float]) -> float:
    """Intersection over union of two boxes, 0 where they do not meet."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return wide * high / (area(a) + area(b) - wide * high)


class Tracker:
    """The live tracks of a key: number, time last seen and box. A track ends when it was not seen for more than `rest`."""

    def __init__(self, saved: str | None, least: float, rest: int) -> None:
        self.seen, self.next, self.live = json.loads(saved) if saved else (None, 0, [])
        self.least, self.rest = least, rest

    def saved(self) -> str:
        return json.dumps([self.seen, self.next, self.live])

    def frame(self, ms: int, boxes: list[list[float]]) -> list[int]:
        """The track of each box of the frame at ms, which is later than all before."""
        self.seen = ms
        self.live = [t for t in self.live if ms - t[1] <= self.rest]
        pairs = sorted((-o, t[0], i) for t in self.live for i, b in enumerate(boxes) if (o := overlap(t[2], b)) >= self.least)
        taken, out = set(), [None] * len(boxes)
        for _, track, i in pairs:
            if out[i] is None and track not in taken:
                out[i] = track
                taken.add(track)
        for i, track in enumerate(out):
            if track is None:
                out[i], self.next = self.next, self.next + 1
        now = {track: [track, ms, boxes[i]] for i, track in enumerate(out)}
        self.live = [t for t in self.live if t[0] not in now] + list(now.values())
        return out


def _linked(rows: pd.DataFrame, tracker: Tracker, key: str) -> pd.DataFrame:
    rows = rows.dropna(subset=["ms", *BOX]).sort_values(["ms", *BOX], kind="stable")
    out = []
    for ms, frame in rows.groupby("ms", sort=True):
        if tracker.seen is None or ms > tracker.seen:
            boxes = frame[list(BOX)].astype(float).to_numpy().tolist()
            out += [(frame[key].iloc[0], int(ms), *b, t) for b, t in zip(boxes, tracker.frame(int(ms), boxes), strict=True)]
    return pd.DataFrame(out, columns=[key, "ms", *BOX, "track"])


def tracks(df: DataFrame, key: str, least: float = 0.3, rest: int = 1000, late: str = "1 minute", wait_ms: int = 60_000) -> DataFrame:
    """key, ms, the box and track (from 0 within a key): df (key, ms, x0, y0, x1, y1; a stream has ts, the event time, as well).

    A box goes on with a live track whose last box it overlaps by `least` or more; of equal overlaps the older track, then the smaller box, comes first. Rows with a
    null take no part. In a stream, rows of a frame that is not later than one already linked are left out, and a key without rows while the
    watermark moves by wait_ms is forgotten; it begins again at track 0. A batch has no such end. A key's rows of one trigger, or of the whole batch, are one group: a video.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ms long, x0 double, y0 double, x1 double, y1 double, track long"
    if not df.isStreaming:
        return df.select(key, "ms", *BOX).groupBy(key).applyInPandas(lambda rows: _linked(rows, Tracker(None, least, rest), key), schema)

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        tracker = Tracker(held.get[0] if held.exists else None, least, rest)
        yield _linked(pd.concat(list(frames)), tracker, key)
        held.update((tracker.saved(),))
        held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + wait_ms)

    rows = df.withWatermark("ts", late).select("ts", key, "ms", *BOX)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "tracks string", "append", GroupStateTimeout.EventTimeTimeout)
