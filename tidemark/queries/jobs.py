"""Job tables over the driver's events: each user is a job, event types are its statuses and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import islands, jobs
from tidemark.queries.base import HOUR, MINUTE, E, events, sessions_sql, table

DAY = 24 * HOUR
_STATUS = {"signup": "uploaded", "click": "queued", "view": "running", "purchase": "complete"}
_ORDER = ["signup", "view", "click", "purchase", "error"]


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a value under 20 are failures, all others the user's cancellations."""
    kind = F.create_map(*(F.lit(x) for pair in _STATUS.items() for x in pair))
    status = F.coalesce(kind[F.col("event_type")], F.when(F.col("value") < 20, "failed").otherwise("cancelled"))
    return events(spark, sf_dir).withColumn("status", status)


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.last_status(_statuses(spark, sf_dir), ["user_id"], "t", "event_id", "status", F.col("value") >= 10)


def segment_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as segments; every purchase is an edit of all its user's segments."""
    e = events(spark, sf_dir)
    own = islands.sessions(e.filter("event_type = 'click'"), ["user_id"], "t", 6 * HOUR, "event_id").select("user_id", "start", "end", F.col("n").alias("points"))
    return jobs.edited(own, e.filter("event_type = 'purchase'").select("user_id", "t"), ["user_id"], "t")


def stripped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://[^/?#]*|[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", jobs.base_name(path).alias("name"))


def public_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs: the text is the error, the language the result, and the source tells the status."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("source").endswith("1"), "running").otherwise("complete").alias("status"), F.col("text").alias("error"), F.col("lang").alias("result"), F.col("source").alias("output_path"))
    return jobs.public_view(rows, "status", "error", ["result"])


def stage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("state", F.when(F.col("value") >= 50, "slow").when(F.col("value") >= 25, "done"))
    return jobs.stage_summary(e, ["user_id"], "event_type", "state", _ORDER)


def queue_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, how many users are in any of the five sets of event types."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    return jobs.occupancy([e.filter(F.col("event_type") == k) for k in _ORDER], ["day"], "user_id")


def stage_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each user's sessions, summed by type."""
    own = islands.sessions(events(spark, sf_dir), ["user_id", "event_type"], "t", 12 * HOUR, "event_id")
    return own.groupBy("user_id", F.col("event_type").alias("name")).agg(F.sum(F.col("end") - F.col("start")).alias("elapsed"), F.count("*").alias("times"))


def stale_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups on days without any other event of their user, more than an hour older than the newest."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    return jobs.stale(e.filter("event_type = 'signup'").select("event_id", "user_id", "day", "t"), e.filter("event_type <> 'signup'"), ["user_id", "day"], "t", 60 * MINUTE)


def serve_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.event_timeline(events(spark, sf_dir).filter("event_type = 'signup'"), ["user_id"], "value")
    return out.select("user_id", "n", F.array_join(F.col("serves").cast("array<string>"), ",").alias("serves"))


def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, sources as jobs, by language."""
    return jobs.usage(table(spark, sf_dir, "documents"), ["lang"], "source", F.octet_length("text"))


def storage_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days with events as jobs and the values as bytes; views take reservations and errors wait."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    used = jobs.usage(e, ["user_id"], "day", F.floor("value"))
    busy = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("reserved"), F.count_if(F.col("event_type") == "error").alias("pending"))
    return jobs.admission(used.join(busy, "user_id"), 28, 3600, 1000, 15)


def racket_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user has a list of episodes, the clicks; the others a decision a day, every other one with stroke episodes,
    the rest with actions, of which signups are the serves."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    item = F.struct(F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "serve").otherwise(F.col("event_type")).alias("action"))
    days = e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(item)).alias("all"), F.sort_array(F.collect_list(F.when(F.col("event_type") == "click", item))).alias("clicks"))
    even = F.col("day") % 2 == 0
    decision = F.struct("day", F.when(even, F.col("all")).alias("stroke_episodes"), F.when(~even, F.col("all")).alias("actions"))
    users = days.groupBy("user_id").agg(F.when(F.col("user_id") % 3 == 0, F.flatten(F.collect_list("clicks"))).alias("episodes"), F.sort_array(F.collect_list(decision)).alias("decisions"))
    found = jobs.actions(F.col("episodes"), F.col("decisions"))
    return users.select("user_id", F.array_join(F.array_sort(F.transform(found, lambda x: x["id"])), ",").alias("actions"))


QUERIES = {f.__name__: f for f in (job_status, segment_versions, stripped_paths, public_jobs, stage_list, queue_occupancy, stage_timers, stale_uploads, serve_timeline, storage_usage, storage_admission, racket_actions)}

_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " ELSE CASE WHEN value < 20 THEN 'failed' ELSE 'cancelled' END END"
_PATH = r"regexp_replace(url, '^[a-z]+://[^/?#]*|[?#].*$', '', 'g')"

SQL = {
    "job_status": f"""WITH {E}, s AS (SELECT *, {_CASE} AS status FROM e),
 l AS (SELECT user_id, arg_max(status, (t, event_id)) AS last, arg_max(value >= 10, (t, event_id)) FILTER (status = 'complete') AS ready FROM s GROUP BY user_id)
 SELECT user_id, CASE WHEN last <> 'cancelled' OR ready IS NULL THEN last WHEN ready THEN 'complete' ELSE 'no_output' END AS status, last IN ('cancelled', 'failed') AS retryable FROM l""",
    "segment_versions": f"""WITH {E}, {sessions_sql("user_id", 6 * HOUR, "event_type = 'click'")}, c AS (SELECT user_id, count(*) AS edits, max(t) AS edited_at FROM e WHERE event_type = 'purchase' GROUP BY 1)
 SELECT s.user_id, s."start", s."end", CASE WHEN edits IS NULL THEN n ELSE 0 END AS points, edited_at, coalesce(edits, 0) + 1 AS version, edits IS NOT NULL AS actions_stale FROM s LEFT JOIN c ON s.user_id = c.user_id""",
    "stripped_paths": rf"SELECT page_id, CASE WHEN starts_with({_PATH}, '/') THEN regexp_extract({_PATH}, '([^/]*)/*$', 1) ELSE {_PATH} END AS name FROM pages",
    "public_jobs": r"""SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'running' ELSE 'complete' END AS status,
 CASE WHEN length(text) > 1500 THEN regexp_replace(left(text, 1500), '[\x20\x09-\x0D]+$', '') || ' ...' ELSE text END AS error, CASE WHEN source LIKE '%1' THEN NULL ELSE lang END AS result FROM documents""",
    "stage_list": f"""WITH {E}, p AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i + 1})" for i, k in enumerate(_ORDER))}) v(stage, position))
 SELECT user_id, position, stage, coalesce(max(CASE WHEN value >= 50 THEN 'slow' WHEN value >= 25 THEN 'done' END), 'recorded') AS status FROM e JOIN p ON e.event_type = p.stage GROUP BY 1, 2, 3""",
    "queue_occupancy": f"WITH {E} SELECT t // {DAY} AS day, count(DISTINCT user_id) AS occupied FROM e WHERE event_type IN ({', '.join(repr(k) for k in _ORDER)}) GROUP BY 1",
    "stage_timers": f"""WITH {E}, {sessions_sql("user_id, event_type", 12 * HOUR)} SELECT user_id, event_type AS name, sum("end" - "start")::BIGINT AS elapsed, count(*) AS times FROM s GROUP BY 1, 2""",
    "stale_uploads": f"""WITH {E}, d AS (SELECT *, t // {DAY} AS day FROM e), u AS (SELECT event_id, user_id, day, t, max(t) OVER () AS newest FROM d WHERE event_type = 'signup')
 SELECT event_id, user_id, day, t FROM u WHERE newest - t > {60 * MINUTE} AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = u.user_id AND d.day = u.day AND d.event_type <> 'signup')""",
    "serve_timeline": f"WITH {E} SELECT user_id, count(*) AS n, string_agg(round(value * 1000)::BIGINT::VARCHAR, ',' ORDER BY round(value * 1000)) AS serves FROM e WHERE event_type = 'signup' AND isfinite(value) GROUP BY 1",
    "storage_usage": "SELECT lang, count(DISTINCT source) AS jobs, coalesce(sum(strlen(text)), 0)::BIGINT AS used FROM documents GROUP BY 1",
    "storage_admission": f"""WITH {E}, u AS (SELECT user_id, count(DISTINCT t // {DAY}) AS jobs, coalesce(sum(floor(value)), 0)::BIGINT AS used, count(*) FILTER (event_type = 'view') AS reserved, count(*) FILTER (event_type = 'error') AS pending FROM e GROUP BY 1),
 v AS (SELECT *, CASE WHEN jobs >= 28 THEN 'jobs' WHEN 3600 - used - reserved <= 0 THEN 'bytes' WHEN pending >= 15 THEN 'queue' ELSE 'accepted' END AS verdict FROM u)
 SELECT *, CASE WHEN verdict = 'accepted' THEN least(1000, 3600 - used - reserved) END::BIGINT AS reservation FROM v""",
    "racket_actions": f"""WITH {E}, d AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN event_type = 'click' ELSE t // {DAY} % 2 = 0 OR event_type <> 'signup' END AS kept FROM e)
 SELECT user_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (kept), '') AS actions FROM d GROUP BY 1""",
}
