"""Adapters from the driver's tables to timelines, and the same adapters as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline: t in microseconds, side 0 or 1 by user."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", t.alias("t"), "event_type", "value", "props", (F.col("user_id") % 2).alias("side"))


E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type, value, props, user_id % 2 AS side FROM events)"


def sessions_sql(keys: str, gap: int, where: str = "TRUE", name: str = "s") -> str:
    """CTEs that end in `name`: keys, session, start, end, n of events e."""
    return f"""
{name}_new AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY {keys} ORDER BY t, event_id) > {gap})::INT, 1) AS fresh FROM e WHERE {where}),
{name}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t, event_id)::BIGINT AS session FROM {name}_new),
{name} AS (SELECT {keys}, session, min(t) AS "start", max(t) AS "end", count(*) AS n, arg_max(event_id, (value, -t, -event_id)) AS top
      FROM {name}_run GROUP BY {keys}, session)"""


def islands_sql(source: str, keys: str, name: str, slack: int = 0, weight: str = "1") -> str:
    """CTEs that end in `name`: keys, start, end, parts, weight of the coalesced intervals of source."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead, group = (f"{keys}, ", f"{keys}, ") if keys else ("", "")
    return f"""
{name}_new AS (SELECT *, coalesce(("start" > max("end") OVER ({part}ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack})::INT, 1) AS fresh
      FROM {source} WHERE "end" >= "start"),
{name}_run AS (SELECT *, sum(fresh) OVER ({part}ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_new),
{name} AS (SELECT {lead}min("start") AS "start", max("end") AS "end", count(*) AS parts, sum({weight})::BIGINT AS weight FROM {name}_run GROUP BY {group}island)"""
