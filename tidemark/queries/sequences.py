"""Sessions, islands, kinematics, smoothing and suppression over events and shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, islands, timeline
from tidemark.operators.ranges import band_semi
from tidemark.queries.base import HOUR, MINUTE, E, events, islands_sql, sessions_sql, table

DAY = 24 * HOUR


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with their strongest event."""
    return islands.sessions(events(spark, sf_dir), ["user_id"], "t", 12 * HOUR, "event_id", best="value")


def live_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with some length, united over all users: the stretches in which anyone was active."""
    own = islands.sessions(events(spark, sf_dir), ["user_id"], "t", HOUR, "event_id").filter("end > start")
    return islands.coalesce_globally(own.select("start", "end", "n"), 6 * HOUR, weight="n").select("start", "end", "parts", "n")


def kept_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = islands.sessions(events(spark, sf_dir), ["event_type", "user_id"], "t", 12 * HOUR, "event_id")
    return islands.union_length(own, ["event_type"], width=24.0 * HOUR)


def shipment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in which each supplier had goods on the way, gaps of up to two days bridged."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("start")).agg(F.max("l_quantity").cast("long").alias("q"))
    out = islands.coalesce_intervals(rows.select("l_suppkey", "start", (F.col("start") + F.col("q")).alias("end")), ["l_suppkey"], slack=2)
    return out.select("l_suppkey", "start", "end", "parts")


def near_duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.collapse_near(events(spark, sf_dir), ["user_id"], "t", "event_id", 2 * HOUR).select("event_id", "user_id", "t")


def centred_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.centred_speed(events(spark, sf_dir), ["user_id"], "t", "event_id", "value", 6 * HOUR, HOUR).select("event_id", "user_id", "t", "speed")


def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.local_maxima(events(spark, sf_dir), ["user_id"], "t", "event_id", "value", 50.0, 2 * DAY).select("event_id", "user_id", "t", "value")


def median_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.median_smoothed(events(spark, sf_dir), ["user_id"], "t", "value", 12 * HOUR).select("event_id", "smooth")


def enrolment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.enrolled(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", F.col("value") > 120).select("event_id", "user_id", "event_type", "t")


def state_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.state_runs(events(spark, sf_dir), ["user_id"], "t", "event_type", "event_id")


def alternating_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("turn", F.when(F.col("event_type") != "error", F.col("side")))
    return islands.alternating_runs(rows.withColumn("all", F.floor(F.col("t") / DAY)), ["all"], "t", "turn", "event_id", HOUR)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating user and assistant turns; a system turn has no side."""
    rows = table(spark, sf_dir, "conversations").withColumn("side", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1))
    return islands.alternating_runs(rows, ["conv_id"], "turn", "side", "turn", 1)


def service_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups of one user group while the last had no purchase within (30 min, 12 h] and came at most a day before."""
    e = events(spark, sf_dir)
    serves, hits = e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("hit"))
    back = band_semi(serves, "event_id", hits, ["user_id"], "hit", F.col("t") + 30 * MINUTE, F.col("t") + 12 * HOUR, 12 * HOUR, open_low=True)
    rows = serves.join(back.select("event_id", F.lit(1).alias("returned")), "event_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    w = islands._running(["user_id"], "t", "event_id")
    new = F.coalesce(((F.col("t") - F.lag("t").over(w) > DAY) | (F.lag("returned").over(w) == 1)).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w))
    first = F.coalesce(F.min(F.when(F.col("returned") == 1, F.col("t"))), F.max("t"))
    return rows.groupBy("user_id", "grp").agg(F.count("*").alias("serves"), F.max("returned").alias("returned"), F.min("t").alias("start"), first.alias("served"))


def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppressed(events(spark, sf_dir), ["user_id"], "t", "value", "event_id", DAY)


def spaced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppressed(events(spark, sf_dir), ["user_id"], "t", "value", "event_id", DAY, limit=5)


_NMS = f"""
WITH RECURSIVE {E},
ranked AS (SELECT user_id, event_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM e),
step AS (
  SELECT user_id, event_id, t, value, rn, TRUE AS keep, [t] AS kept FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.t, r.value, r.rn, len(list_filter(s.kept, lambda x: abs(x - r.t) < {DAY})) = 0,
         CASE WHEN len(list_filter(s.kept, lambda x: abs(x - r.t) < {DAY})) = 0 THEN list_append(s.kept, r.t) ELSE s.kept END
  FROM step s JOIN ranked r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
"""

QUERIES = {f.__name__: f for f in (sessions, live_intervals, kept_time, shipment_coverage, near_duplicate_collapse, centred_kinematics, local_maxima, median_smoothing, enrolment_filter, state_islands, alternating_runs, conversation_turns, service_groups, greedy_nms, spaced_topk)}

_W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"

SQL = {
    "sessions": f'WITH {E}, {sessions_sql("user_id", 12 * HOUR)} SELECT user_id, session, "start", "end", n, top FROM s',
    "live_intervals": f'WITH {E}, {sessions_sql("user_id", HOUR)}, live AS (SELECT * FROM s WHERE "end" > "start"), {islands_sql("live", "", "i", weight="n")} SELECT "start", "end", parts, weight AS n FROM i',
    "kept_time": f'WITH {E}, {sessions_sql("event_type, user_id", 12 * HOUR)}, live AS (SELECT * FROM s WHERE "end" > "start"), {islands_sql("live", "event_type", "i")} SELECT event_type, sum("end" - "start")::BIGINT AS covered FROM i GROUP BY event_type',
    "shipment_coverage": f"""WITH ships AS (SELECT l_suppkey, epoch(l_shipdate)::BIGINT // 86400 AS "start", max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
 spans AS (SELECT l_suppkey, "start", "start" + q AS "end" FROM ships), {islands_sql("spans", "l_suppkey", "i", slack=2)} SELECT l_suppkey, "start", "end", parts FROM i""",
    "near_duplicate_collapse": f"WITH {E}, w AS (SELECT *, lead(t) {_W} - t AS step FROM e) SELECT event_id, user_id, t FROM w WHERE step IS NULL OR step >= {2 * HOUR}",
    "centred_kinematics": f"""WITH {E}, w AS (SELECT *, t - lag(t) {_W} AS b, abs(value - lag(value) {_W}) AS bv, lead(t) {_W} - t AS a, abs(lead(value) {_W} - value) AS av FROM e)
 SELECT event_id, user_id, t, coalesce(greatest(CASE WHEN b > 0 AND b <= {6 * HOUR} THEN bv / (b / {HOUR}.0::DOUBLE) END, CASE WHEN a > 0 AND a <= {6 * HOUR} THEN av / (a / {HOUR}.0::DOUBLE) END), 0.0) AS speed FROM w""",
    "local_maxima": f"""WITH {E}, w AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top,
 lead(t, 2) {_W} - lag(t, 2) {_W} AS width FROM e) SELECT event_id, user_id, t, value FROM w WHERE width <= {2 * DAY} AND value >= 50 AND value = top""",
    "median_smoothing": f"WITH {E} SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {12 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING) AS smooth FROM e",
    "enrolment_filter": f"WITH {E}, w AS (SELECT *, max((value > 120)::INT) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS ever FROM e) SELECT event_id, user_id, event_type, t FROM w WHERE ever = 1",
    "state_islands": f"""WITH {E}, w AS (SELECT *, (lag(t) {_W} IS NULL OR event_type <> lag(event_type) {_W})::INT AS fresh FROM e), r AS (SELECT *, sum(fresh) {_W}::BIGINT AS run FROM w)
 SELECT user_id, run, min(event_type) AS event_type, min(t) AS "start", max(t) AS "end", count(*) AS n, arg_min(event_id, (t, event_id)) AS first FROM r GROUP BY user_id, run""",
    "alternating_runs": f"""WITH {E}, f AS (SELECT *, t // {DAY} AS "all" FROM e WHERE event_type <> 'error'),
 w AS (SELECT *, coalesce((t - lag(t) OVER p > {HOUR} OR lag(side) OVER p = side)::INT, 1) AS fresh FROM f WINDOW p AS (PARTITION BY "all" ORDER BY t, event_id)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY "all" ORDER BY t, event_id)::BIGINT AS run FROM w)
 SELECT "all", run, min(t) AS "start", max(t) AS "end", count(*) AS n, arg_min(side, (t, event_id)) AS first_side FROM r GROUP BY "all", run HAVING count(*) >= 3""",
    "conversation_turns": """WITH f AS (SELECT *, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS side FROM conversations WHERE role IN ('user', 'assistant')),
 w AS (SELECT *, coalesce((turn - lag(turn) OVER p > 1 OR lag(side) OVER p = side)::INT, 1) AS fresh FROM f WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM w)
 SELECT conv_id, run, min(turn) AS "start", max(turn) AS "end", count(*) AS n, arg_min(side, turn) AS first_side FROM r GROUP BY conv_id, run HAVING count(*) >= 3""",
    "service_groups": f"""WITH {E}, serves AS (SELECT *, EXISTS (SELECT 1 FROM e h WHERE h.event_type = 'purchase' AND h.user_id = e.user_id AND h.t > e.t + {30 * MINUTE} AND h.t <= e.t + {12 * HOUR})::INT AS returned FROM e WHERE event_type = 'signup'),
 w AS (SELECT *, coalesce((t - lag(t) {_W} > {DAY} OR lag(returned) {_W} = 1)::INT, 1) AS fresh FROM serves), g AS (SELECT *, sum(fresh) {_W}::BIGINT AS grp FROM w)
 SELECT user_id, grp, count(*) AS serves, max(returned) AS returned, min(t) AS "start", coalesce(min(t) FILTER (returned = 1), max(t)) AS served FROM g GROUP BY user_id, grp""",
    "greedy_nms": _NMS + "SELECT user_id, event_id, t, value FROM step WHERE keep",
    "spaced_topk": _NMS + "SELECT user_id, event_id, t, value FROM step WHERE keep QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5",
}
