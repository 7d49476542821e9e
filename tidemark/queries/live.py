"""Streaming queries, run over all files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries.base import E, sessions_sql
from tidemark.sources.scratch import folder as new_folder
from tidemark.streaming import live

HALF_DAY = 12 * 3_600_000_000


def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user from a stream; all of them, as at the end of the stream."""
    folder = new_folder(spark, "stream")
    found = live.sessions(live.event_stream(spark, sf_dir), ["user_id"], "12 hours", "1 day")
    live.run_available(found, live.fenced_sink(f"{folder}/out", "a", lambda: "a"), f"{folder}/state", mode="complete")
    us = lambda c: F.unix_micros(c).alias(c)
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("user_id", us("start"), us("end"), "n")


QUERIES = {"streaming_sessions": streaming_sessions}
SQL = {"streaming_sessions": f'WITH {E}, {sessions_sql("user_id", HALF_DAY)} SELECT user_id, "start", "end", n FROM s'}
