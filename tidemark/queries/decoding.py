"""Window states, live bouts, alternating scans, hypotheses, endpoints, quality gate and output layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, islands, timeline
from tidemark.plans import points
from tidemark.queries.base import HOUR, MINUTE, E, events, sessions_sql

DAY = 24 * HOUR
_SEED, _SUPPORT, _IDLE = ("signup", "purchase"), "click", "view"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*map(F.lit, ("signup", "LIVE_SEED", "purchase", "LIVE_SUPPORT", "click", "LIVE_SUPPORT", "view", "BETWEEN_POINTS", "error", "UNKNOWN")))
    return events(spark, sf_dir).withColumn("state", kind[F.col("event_type")])


def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event classified from the events of its day within an hour of it."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    out = timeline.window_states(rows, ["day"], "t", "event_type", "side", HOUR, _SEED, _SUPPORT, _IDLE)
    return out.select("event_id", "t", "n_near", "n_seed", "n_support", "sides", "idle_share", "evidence_start", "evidence_end", "state")


def bout_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live bouts of each user; a task sorts a month of one user, however much of the table is theirs."""
    month = F.floor(F.col("t") / (30 * DAY))
    return folds.bouts(_states(spark, sf_dir), ["user_id"], "t", "event_id", "state", 2.0 * HOUR, 24.0 * HOUR, bucket=month).drop("transition")


def alternating_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per quarter of a day, events in turn from its start on, side 0 first, until a step of over an hour."""
    e = events(spark, sf_dir).withColumn("part", F.floor(F.col("t") / (6 * HOUR)))
    out = folds.alternating_scan(e, ["part"], "t", "event_id", "side", F.lit(0), F.col("part") * (6 * HOUR), 5.0 * MINUTE, 1.0 * HOUR)
    return out.select("part", F.size("accepted").cast("long").alias("n"), F.array_join(F.col("accepted").cast("array<string>"), ",").alias("accepted"), "skipped", "stopped")


def context_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by side widened by 30 and 20 minutes, gaps that are too short split between neighbours."""
    own = islands.sessions(events(spark, sf_dir).filter("event_type = 'click'"), ["side"], "t", 30 * MINUTE, "event_id", bucket=F.floor(F.col("t") / DAY)).filter("end > start")
    rows = own.select("side", (F.col("start") / MINUTE).alias("start"), (F.col("end") / MINUTE).alias("end")).withColumn("limit", F.lit(1e12))
    return islands.padded(rows, ["side"], 30.0, 20.0, "limit", width=30 * 24 * 60.0).drop("limit")


def output_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = islands.sessions(events(spark, sf_dir).filter("event_type = 'click'"), ["side"], "t", 30 * MINUTE, "event_id", bucket=F.floor(F.col("t") / DAY)).filter("end > start")
    return islands.layout(own.select("side", "start", "end"), ["side"], MINUTE, width=30.0 * DAY)


def point_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serves (signups) joined with live bouts of their user; bouts that no serve covers stand alone."""
    e = _states(spark, sf_dir)
    serves = e.filter("event_type = 'signup'").select("user_id", "event_id", F.col("t").cast("double").alias("t"), F.col("value").alias("score"))
    live = folds.bouts(e, ["user_id"], "t", "event_id", "state", 2.0 * HOUR, 24.0 * HOUR)
    return points.hypotheses(serves, live, ["user_id"], search=6.0 * HOUR, uncovered=0.5 * HOUR, supersede=5.0 * HOUR, width=2.0 * DAY)


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each hypothesis ends, and why it is kept or dropped."""
    return points.endpoints(point_hypotheses(spark, sf_dir), ["user_id"], duration=float(1 << 62), unreturned=3.0 * HOUR, tail=12.0 * HOUR, least=1.0 * HOUR)


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.quality_gate(endpoints(spark, sf_dir), ["user_id"], retention=0.5, gap=12.0 * HOUR)


QUERIES = {f.__name__: f for f in (live_windows, bout_automaton, alternating_scan, context_padding, output_layout, point_hypotheses, endpoints, quality_gate)}

_B, _U = 2 * HOUR, 24 * HOUR
_LIVE = "s.state IN ('LIVE_SEED', 'LIVE_SUPPORT')"
_PEND = "coalesce(r.pend, s.t)"
_SHUT1 = f"(r.open AND s.state = 'BETWEEN_POINTS' AND s.t - {_PEND} >= {_B})"
_SHUT2 = f"(r.open AND s.state = 'UNKNOWN' AND s.t - r.last > {_U})"
_BOUTS = f"""
WITH RECURSIVE {E},
s AS (SELECT user_id, t::DOUBLE AS t, CASE event_type WHEN 'signup' THEN 'LIVE_SEED' WHEN 'purchase' THEN 'LIVE_SUPPORT' WHEN 'click' THEN 'LIVE_SUPPORT' WHEN 'view' THEN 'BETWEEN_POINTS' ELSE 'UNKNOWN' END AS state,
  row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e),
r AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, FALSE AS open, NULL::DOUBLE AS "start", NULL::DOUBLE AS last, 0::BIGINT AS n, NULL::DOUBLE AS pend, NULL::DOUBLE AS c_start, NULL::DOUBLE AS c_end, 0::BIGINT AS c_n, NULL::VARCHAR AS c_src FROM s
  UNION ALL
  SELECT s.user_id, s.rn,
    CASE WHEN NOT r.open THEN s.state = 'LIVE_SEED' ELSE NOT ({_SHUT1} OR {_SHUT2}) END,
    CASE WHEN NOT r.open THEN CASE WHEN s.state = 'LIVE_SEED' THEN s.t END WHEN {_SHUT1} OR {_SHUT2} THEN NULL ELSE r."start" END,
    CASE WHEN NOT r.open THEN CASE WHEN s.state = 'LIVE_SEED' THEN s.t END WHEN {_SHUT1} OR {_SHUT2} THEN NULL WHEN {_LIVE} THEN s.t ELSE r.last END,
    CASE WHEN NOT r.open THEN (s.state = 'LIVE_SEED')::BIGINT WHEN {_SHUT1} OR {_SHUT2} THEN 0 WHEN {_LIVE} THEN r.n + 1 ELSE r.n END,
    CASE WHEN r.open AND s.state = 'BETWEEN_POINTS' AND NOT {_SHUT1} THEN {_PEND} END,
    CASE WHEN {_SHUT1} OR {_SHUT2} THEN r."start" END,
    CASE WHEN {_SHUT1} THEN {_PEND} WHEN {_SHUT2} THEN r.last END,
    CASE WHEN {_SHUT1} OR {_SHUT2} THEN r.n END,
    CASE WHEN {_SHUT1} THEN 'between' WHEN {_SHUT2} THEN 'unknown' END
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1),
bouts AS (
  SELECT user_id, c_start AS "start", c_end AS "end", c_n AS live_rows, c_src AS end_source FROM r WHERE c_end > c_start
  UNION ALL
  SELECT user_id, "start", last, n, 'timeline' FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1) WHERE open AND last > "start")"""
_HYP = f"""{_BOUTS},
serves AS (SELECT user_id, event_id, t::DOUBLE AS t, value AS score FROM e WHERE event_type = 'signup'),
hit AS (SELECT v.*, b."start" AS b_start, b."end" AS b_end FROM serves v LEFT JOIN bouts b ON v.user_id = b.user_id AND b."start" <= v.t + {6 * HOUR} AND v.t <= b."end"
  QUALIFY row_number() OVER (PARTITION BY v.user_id, v.event_id ORDER BY least(b."end", v.t + {6 * HOUR}) - greatest(b."start", v.t) DESC NULLS LAST, b."end" - b."start" DESC NULLS LAST, b."start" DESC) = 1),
served AS (SELECT user_id, 'serve' AS kind, t AS "start", coalesce(b_end, t) AS live_end, score, b_start IS NOT NULL AS has_bout FROM hit),
alone AS (SELECT b.user_id, 'live_state' AS kind, b."start", b."end" AS live_end, NULL::DOUBLE AS score, TRUE AS has_bout FROM bouts b
  WHERE NOT EXISTS (SELECT 1 FROM served v WHERE v.user_id = b.user_id AND least(v.live_end, b."end") - greatest(v."start", b."start") > {HOUR // 2})),
marked AS (SELECT *, lead("start") OVER (PARTITION BY user_id ORDER BY "start", live_end) - live_end AS gap FROM alone),
hyp AS (SELECT user_id, kind, "start", live_end, score, has_bout FROM served UNION ALL
  SELECT user_id, kind, "start", live_end, score, has_bout FROM marked WHERE NOT coalesce(gap BETWEEN 0 AND {5 * HOUR}, FALSE))"""
_END = f"""{_HYP},
nxt AS (SELECT *, coalesce(lead("start") OVER (PARTITION BY user_id ORDER BY "start", kind = 'serve' DESC, live_end, score), {1 << 62}::DOUBLE) AS limit_end FROM hyp),
fin AS (SELECT user_id, kind, "start", has_bout, live_end, greatest("start", least(CASE WHEN has_bout THEN live_end ELSE "start" + {3 * HOUR} END, limit_end)) AS "end", CASE WHEN has_bout THEN 'live_end' ELSE 'bounded_window' END AS source FROM nxt),
ends AS (SELECT user_id, kind, "start", "end", source, CASE WHEN has_bout AND live_end - "end" > {12 * HOUR} THEN 'unexplained_tail' WHEN "end" - "start" < {HOUR} THEN 'too_short' END AS dropped FROM fin)"""

SQL = {
    "live_windows": f"""WITH {E}, d AS (SELECT *, t // {DAY} AS day, (event_type IN ('signup', 'purchase'))::INT AS sd, (event_type = 'click')::INT AS sp, (event_type = 'view')::INT AS idle FROM e),
 w AS (SELECT event_id, t, count(*) OVER f AS n_near, sum(sd) OVER f ::BIGINT AS n_seed, sum(sp) OVER f ::BIGINT AS n_support, sum(idle) OVER f AS n_idle,
  max(CASE WHEN sd = 1 AND side = 0 THEN 1 ELSE 0 END) OVER f + max(CASE WHEN sd = 1 AND side = 1 THEN 1 ELSE 0 END) OVER f AS sides,
  min(CASE WHEN sd + sp > 0 THEN t END) OVER f AS evidence_start, max(CASE WHEN sd + sp > 0 THEN t END) OVER f AS evidence_end
  FROM d WINDOW f AS (PARTITION BY day ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND {HOUR} FOLLOWING))
 SELECT event_id, t, n_near, n_seed, n_support, sides, n_idle / n_near AS idle_share, evidence_start, evidence_end,
  CASE WHEN (n_seed >= 2 AND sides = 2) OR (n_seed >= 1 AND n_support >= 1) THEN 'LIVE_SEED' WHEN n_support >= 2 THEN 'LIVE_SUPPORT' WHEN 2 * n_idle > n_near THEN 'BETWEEN_POINTS' ELSE 'UNKNOWN' END AS state FROM w""",
    "bout_automaton": f'{_BOUTS} SELECT user_id, "start", "end", live_rows, end_source FROM bouts',
    "alternating_scan": f"""WITH RECURSIVE {E}, s AS (SELECT t // {6 * HOUR} AS part, t::DOUBLE AS t, event_id, side, row_number() OVER (PARTITION BY t // {6 * HOUR} ORDER BY t, event_id) AS rn FROM e),
 r AS (SELECT DISTINCT part, 0::BIGINT AS rn, part * {6 * HOUR}::DOUBLE AS last, 0::BIGINT AS want, FALSE AS stop, 0::BIGINT AS skip, []::BIGINT[] AS acc FROM s
  UNION ALL
  SELECT s.part, s.rn,
   CASE WHEN r.stop OR (len(r.acc) = 0 AND s.t <= r.last + {5 * MINUTE}) OR s.t - r.last > {HOUR} OR s.side <> r.want THEN r.last ELSE s.t END,
   CASE WHEN r.stop OR (len(r.acc) = 0 AND s.t <= r.last + {5 * MINUTE}) OR s.t - r.last > {HOUR} OR s.side <> r.want THEN r.want ELSE 1 - r.want END,
   r.stop OR (NOT (len(r.acc) = 0 AND s.t <= r.last + {5 * MINUTE}) AND s.t - r.last > {HOUR}),
   r.skip + (NOT r.stop AND NOT (len(r.acc) = 0 AND s.t <= r.last + {5 * MINUTE}) AND s.t - r.last <= {HOUR} AND s.side <> r.want)::BIGINT,
   CASE WHEN r.stop OR (len(r.acc) = 0 AND s.t <= r.last + {5 * MINUTE}) OR s.t - r.last > {HOUR} OR s.side <> r.want THEN r.acc ELSE list_append(r.acc, s.event_id) END
  FROM r JOIN s ON s.part = r.part AND s.rn = r.rn + 1)
 SELECT part, len(acc)::BIGINT AS n, array_to_string(acc, ',') AS accepted, skip AS skipped, stop AS stopped FROM r QUALIFY row_number() OVER (PARTITION BY part ORDER BY rn DESC) = 1""",
    "context_padding": f"""WITH {E}, {sessions_sql("side", 30 * MINUTE, "event_type = 'click'")}, x AS (SELECT side, "start" / {MINUTE}.0::DOUBLE AS "start", "end" / {MINUTE}.0::DOUBLE AS "end" FROM s WHERE "end" > "start"),
 w AS (SELECT *, lag("end") OVER p AS l, lead("start") OVER p AS r FROM x WINDOW p AS (PARTITION BY side ORDER BY "start", "end"))
 SELECT side, "start", "end", CASE WHEN l IS NOT NULL AND l + 20 > "start" - 30 THEN CASE WHEN "start" >= l THEN l + ("start" - l) * (20.0::DOUBLE / 50) ELSE "start" END ELSE greatest("start" - 30, 0) END AS padded_start,
  CASE WHEN r IS NOT NULL AND "end" + 20 > r - 30 THEN CASE WHEN r >= "end" THEN "end" + (r - "end") * (20.0::DOUBLE / 50) ELSE "end" END ELSE least("end" + 20, 1e12) END AS padded_end FROM w""",
    "output_layout": f"""WITH {E}, {sessions_sql("side", 30 * MINUTE, "event_type = 'click'")}, x AS (SELECT side, "start", "end" FROM s WHERE "end" > "start")
 SELECT side, "start", "end", row_number() OVER p - 1 AS idx, coalesce(sum("end" - "start" + {MINUTE}) OVER (PARTITION BY side ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS out_start,
  coalesce(sum("end" - "start" + {MINUTE}) OVER (PARTITION BY side ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + ("end" - "start") AS out_end,
  CASE WHEN lead("start") OVER p IS NOT NULL THEN greatest(lead("start") OVER p - "end", 0) END::DOUBLE AS pause FROM x WINDOW p AS (PARTITION BY side ORDER BY "start", "end")""",
    "point_hypotheses": f'{_HYP} SELECT user_id, kind, "start", live_end, score, has_bout FROM hyp',
    "endpoints": f'{_END} SELECT user_id, kind, "start", "end", source, dropped FROM ends',
    "quality_gate": f"""{_END}, k AS (SELECT *, CASE WHEN lead("start") OVER w IS NOT NULL THEN greatest(lead("start") OVER w - "end", 0) END AS gap FROM ends WHERE dropped IS NULL WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")),
 a AS (SELECT user_id, count(*) AS n, sum("end" - "start") / (max("end") - min("start")) AS retention, median(gap) AS median_gap, avg((source = 'bounded_window')::INT) AS bounded_share FROM k GROUP BY user_id)
 SELECT *, coalesce(n >= 3 AND retention >= 0.5 AND median_gap <= {12 * HOUR}, FALSE) AS rejected FROM a""",
}
