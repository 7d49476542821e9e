"""Streaming twins: sessions with watermarks, the bout automaton with state, and fenced idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream with ts as a timestamp."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    """keys, start, end (of the last event), n of each session, given out once the watermark has passed it."""
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap))
    return grouped.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("session_window")


class _Bout:
    """One key's automaton; the same rules as the batch fold."""

    def __init__(self, saved: tuple | None, between: float, bridge: float):
        self.start, self.last, self.n, self.pend = saved or (None, None, 0, None)
        self.between, self.bridge = between, bridge

    def step(self, t: float, state: str) -> tuple | None:
        """The bout that this row closes, if any."""
        live = state in ("LIVE_SEED", "LIVE_SUPPORT")
        if self.start is None:
            if state == "LIVE_SEED":
                self.start, self.last, self.n, self.pend = t, t, 1, None
            return None
        if live:
            self.last, self.n, self.pend = t, self.n + 1, None
            return None
        if state == "BETWEEN_POINTS":
            self.pend = t if self.pend is None else self.pend
            return self.close(self.pend, "between") if t - self.pend >= self.between else None
        if t - self.last > self.bridge:
            return self.close(self.last, "unknown")
        self.pend = None
        return None

    def close(self, end: float, source: str) -> tuple | None:
        out = (self.start, end, self.n, source)
        self.start, self.last, self.n, self.pend = None, None, 0, None
        return out if end > out[0] else None


def bouts(stream: DataFrame, key: str, time: str, tie: str, state: str, between: float, bridge: float, late: str, wait_ms: int) -> DataFrame:
    """Live bouts of each key as they close: key, start, end, live_rows, end_source.

    Rows of one trigger are put in order of time; rows that come after later ones of an earlier trigger are
    left out. A key without rows for wait_ms of event time closes its open bout (`timeline`).
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        saved = held.get if held.exists else None
        bout, seen, out = _Bout(saved[1:] if saved and saved[1] is not None else None, between, bridge), saved[0] if saved else float("-inf"), []
        if held.hasTimedOut:
            held.remove()
            last = bout.close(bout.last, "timeline") if bout.start is not None else None
            out += [last] if last else []
        else:
            rows = pd.concat(list(frames)).sort_values([time, tie], kind="stable")
            for t, s in zip(rows[time].astype(float), rows[state], strict=True):
                if t >= seen:
                    seen, done = t, bout.step(t, s)
                    out += [done] if done else []
            held.update((seen, bout.start, bout.last, bout.n, bout.pend))
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, int(seen / 1000) + wait_ms))
        yield pd.DataFrame([(k[0], *x) for x in out], columns=[key, "start", "end", "live_rows", "end_source"])

    rows = stream.withWatermark("ts", late).select("ts", key, time, tie, state)
    schema = f"{key} long, start double, end double, live_rows long, end_source string"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "seen double, start double, last double, n long, pend double", "append", GroupStateTimeout.EventTimeTimeout)


def fenced_sink(path: str, attempt: str, current: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a batch goes to a folder of its own number, so a replay replaces it, and a writer
    whose attempt is no longer the current one writes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if current() == attempt:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now and stop."""
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
