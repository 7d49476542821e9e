"""Matches made up from events, decoded from serves, strokes and live bouts to points: hypotheses, decisions, strokes in turn, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import islands
from tidemark.plans import decode, live, service
from tidemark.queries.base import E, events

LATEST = float(1 << 20)


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four users a match, one event every second and a half."""
    n = F.row_number().over(Window.partitionBy("m").orderBy("t", "event_id"))
    rows = events(spark, sf_dir).withColumn("m", F.floor(F.col("user_id") / 4))
    return rows.select("m", "event_id", "user_id", "event_type", "value", (n * 1.5).cast("double").alias("t"), F.when(F.col("side") == 0, "near").otherwise("far").alias("end"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Large signups are serves, clicks and purchases strokes, views and errors in close succession bouts."""
    rows = _match(spark, sf_dir)
    half = F.when(F.col("value") > 90, "left").when(F.col("value") > 70, "right")
    serves = rows.filter("event_type = 'signup' and value > 50").select("m", F.col("event_id").alias("serve_id"), F.col("t").alias("strike"), (F.col("t") - 1.0).alias("setup"), "end", half.alias("half"), F.lit(None).cast("string").alias("team"), (F.col("value") / 120).alias("score"), (F.col("value") > 62).alias("evidence"), (F.col("value") > 75).alias("accepted"))
    known = F.when(F.col("value") > 3, F.col("end"))
    strokes = rows.filter("event_type in ('click', 'purchase')").select("m", F.col("event_id").alias("stroke_id"), "t", known.alias("end"))
    calm = rows.filter("event_type in ('view', 'error')")
    bouts = islands.sessions(calm, ["m"], "t", 4.5, "event_id").filter("end > start")
    bouts = bouts.select("m", "start", "end", F.when(F.col("n") >= 5, F.col("end") - 0.5).alias("transition"))
    return serves, strokes, bouts, rows.groupBy("m").agg((F.max("t") + 10).alias("duration"))


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    serves, strokes, bouts, durations = _parts(spark, sf_dir)
    serves = decode.promoted(serves, strokes, ["m"]).filter("accepted")
    return service.point_hypotheses(serves, strokes, bouts, ["m"], LATEST), strokes, durations


def service_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service groups with their return or bout, and what no serve explains."""
    return _hypotheses(spark, sf_dir)[0]


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hyp, strokes, durations = _hypotheses(spark, sf_dir)
    return decode.decoded(hyp.join(durations, "m"), strokes, ["m"], F.col("duration"))


def decoded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each hypothesis ends, why, and why it is dropped."""
    return _decoded(spark, sf_dir)[0].drop("duration")


def point_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strokes in turn of each served hypothesis."""
    return _decoded(spark, sf_dir)[1]


def decoded_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match, whether its points are believed."""
    return decode.quality(_decoded(spark, sf_dir)[0], ["m"], F.col("duration"))


def _players(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two rows a second for each user of a match, ready and moving as its events say; rare events are serves and strokes."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    rows = events(spark, sf_dir).withColumns({"m": F.floor(F.col("user_id") / 4), "ms": (n * 500).cast("long"), "end": F.when(F.col("side") == 0, "near").otherwise("far")})
    players = rows.select("m", "ms", F.col("user_id").alias("actor_id"), "end", F.col("event_type").isin("view", "click").alias("ready"), (F.col("value") / 60).alias("wrist_speed"), (F.col("value") / 40).alias("court_speed"))
    rare = lambda kind: rows.filter(f"event_type = '{kind}' and value > 130").select("m", "ms", F.col("user_id").alias("actor_id"), "end")
    return players, rare("signup"), rare("purchase")


def court_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with what each end shows; relaxed ones."""
    return live.frames(_players(spark, sf_dir)[0], ["m"])


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, serves, strokes = _players(spark, sf_dir)
    seen = live.frames(players, ["m"])
    return live.windows(seen, live.answers(live.numbered(serves, strokes, ["m"]), seen, ["m"]), ["m"])


def court_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every frame from the two seconds around it."""
    return _windows(spark, sf_dir).withColumn("seed_reasons", F.array_join("seed_reasons", ","))


def seed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player shows in the first window of every run of seeds."""
    before = F.lag("state").over(Window.partitionBy("m").orderBy("ms"))
    first = _windows(spark, sf_dir).withColumn("_before", before).filter("state = 'LIVE_SEED' and (_before is null or _before <> 'LIVE_SEED')")
    return live.actor_evidence(_players(spark, sf_dir)[0], first, ["m"])


QUERIES = {f.__name__: f for f in (service_hypotheses, decoded_points, point_actions, decoded_quality, court_frames, court_windows, seed_evidence)}

_OTHER = "CASE {0} WHEN 'near' THEN 'far' WHEN 'far' THEN 'near' END"
_KNOWN = "{0} IN ('near', 'far')"

#: From serves (accepted ones), strokes and bouts to hyp; each step states which rows belong to the result.
HYPOTHESES_SQL = f"""
returned AS (SELECT s.*, EXISTS (SELECT 1 FROM strokes k WHERE k.m = s.m AND k."end" = {_OTHER.format('s."end"')} AND k.t > s.strike + 0.7 AND k.t <= s.strike + 4.5) AS returned FROM serves s),
lagged AS (SELECT *, lag(strike) OVER w AS p_strike, lag(returned) OVER w AS p_returned, lag("end") OVER w AS p_end, lag(half) OVER w AS p_half, lag(team) OVER w AS p_team
  FROM returned WINDOW w AS (PARTITION BY m ORDER BY strike, serve_id)),
tied AS (SELECT *, coalesce(strike - p_strike <= 20 AND NOT p_returned AND (
    (p_end IS NOT DISTINCT FROM "end" AND p_half IS NOT DISTINCT FROM half AND NOT coalesce(p_team <> '' AND team <> '' AND p_team <> team, FALSE))
    OR coalesce({_KNOWN.format('p_end')} AND {_KNOWN.format('"end"')} AND p_end <> "end" AND strike - p_strike <= 30, FALSE)), FALSE) AS joins FROM lagged),
grouped AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY m ORDER BY strike, serve_id ROWS UNBOUNDED PRECEDING) AS g FROM tied),
chosen AS (SELECT *, min(setup) OVER (PARTITION BY m, g) AS cover, count(*) OVER (PARTITION BY m, g) AS attempts FROM grouped
  QUALIFY row_number() OVER (PARTITION BY m, g ORDER BY returned DESC, CASE WHEN returned THEN strike ELSE -strike END, CASE WHEN returned THEN serve_id ELSE -serve_id END) = 1),
hit AS (SELECT c.*, b."start" AS b_start, b."end" AS b_end, b.transition FROM chosen c LEFT JOIN bouts b ON b.m = c.m AND b."end" >= strike - 1 AND b."start" <= strike + 5
  QUALIFY row_number() OVER (PARTITION BY c.m, g ORDER BY least(b."end", strike + 5) - greatest(b."start", strike - 1) DESC NULLS LAST, b."end" - b."start" DESC NULLS LAST, b."start") = 1),
served AS (SELECT m, 'serve' AS kind, setup AS "start", strike AS live_start, coalesce(b_end, strike)::DOUBLE AS live_end, CASE WHEN {_KNOWN.format('"end"')} THEN "end" END AS server_end, attempts,
    CASE WHEN returned THEN 'returned_serve' WHEN b_end IS NOT NULL THEN 'serve_with_play' ELSE 'unreturned_serve' END AS classification, serve_id, b_end IS NOT NULL AS has_bout, transition,
    0::BIGINT AS seed_n, NULL::DOUBLE AS seed_last, cover FROM hit WHERE returned OR b_end IS NOT NULL OR coalesce(score, 0) >= 0.76),
known AS (SELECT *, lag(t) OVER w AS p_t, lag("end") OVER w AS p_end FROM strokes WHERE {_KNOWN.format('"end"')} WINDOW w AS (PARTITION BY m ORDER BY t, stroke_id)),
parts AS (SELECT *, sum((NOT coalesce(t - p_t <= 6 AND "end" <> p_end, FALSE))::INT) OVER (PARTITION BY m ORDER BY t, stroke_id ROWS UNBOUNDED PRECEDING) AS part FROM known),
runs AS (SELECT m, min(t) AS first, max(t) AS last, count(*) AS n FROM parts GROUP BY m, part HAVING count(*) >= 3),
alone AS (SELECT b.* FROM bouts b WHERE b."end" - b."start" >= 5.5
  AND NOT EXISTS (SELECT 1 FROM served s WHERE s.m = b.m AND least(b."end", greatest(s.live_end, s.live_start + 1)) - greatest(b."start", s.cover) > 0.5)),
seeded AS (SELECT a.*, r.first, r.last, r.n FROM alone a LEFT JOIN runs r ON r.m = a.m AND r.first >= a."start" - 0.5 AND r.last <= a."end" + 0.5
  QUALIFY row_number() OVER (PARTITION BY a.m, a."start", a."end" ORDER BY n DESC NULLS LAST, first) = 1),
unserved AS (SELECT m, CASE WHEN n IS NULL THEN 'live_state' ELSE 'exchange' END AS kind, greatest(0, CASE WHEN n IS NULL THEN "start" ELSE greatest("start", first - 6) END)::DOUBLE AS "start",
    coalesce(first, "start")::DOUBLE AS live_start, "end"::DOUBLE AS live_end, NULL::VARCHAR AS server_end, 0::BIGINT AS attempts, CASE WHEN n IS NULL THEN 'play_only' ELSE 'exchange_only' END AS classification,
    NULL::BIGINT AS serve_id, TRUE AS has_bout, transition, coalesce(n, 0)::BIGINT AS seed_n, last::DOUBLE AS seed_last FROM seeded),
followed AS (SELECT *, lead("start") OVER (PARTITION BY m ORDER BY "start", live_end) - live_end AS pause FROM unserved),
every_h AS (SELECT * EXCLUDE (cover) FROM served UNION ALL SELECT * EXCLUDE (pause) FROM followed WHERE NOT (kind = 'live_state' AND coalesce(pause BETWEEN 0 AND 5, FALSE))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY "start", kind <> 'serve', live_start, live_end) AS rn FROM every_h),
once AS (
  SELECT DISTINCT m, 0::BIGINT AS rn, []::STRUCT(rn BIGINT, s DOUBLE, e DOUBLE, srv BOOLEAN)[] AS kept FROM ranked
  UNION ALL
  SELECT m, rn, CASE WHEN p = 0 THEN list_append(kept, h) WHEN h.srv AND NOT kept[p].srv THEN list_concat(kept[:p - 1], [h], kept[p + 1:]) ELSE kept END
  FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda k: least(k.e, h.e) - greatest(k.s, h.s) > 0.5), TRUE), 0) AS p
    FROM (SELECT r.m, r.rn, o.kept, {{'rn': r.rn, 's': r.live_start::DOUBLE, 'e': r.live_end::DOUBLE, 'srv': r.kind = 'serve'}} AS h FROM once o JOIN ranked r ON r.m = o.m AND r.rn = o.rn + 1))),
settled AS (SELECT m, unnest(kept).rn AS rn FROM (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY m ORDER BY rn DESC) = 1)),
hyp AS (SELECT ranked.* EXCLUDE (rn) FROM ranked JOIN settled USING (m, rn))"""

#: From hyp, strokes and durations to fin (decisions) and scan (the walk over each served hypothesis' strokes).
DECODED_SQL = f"""
ordered AS (SELECT hyp.*, duration, row_number() OVER o - 1 AS no, coalesce(lead("start") OVER o, duration) AS next_start FROM hyp JOIN durations USING (m)
  WINDOW o AS (PARTITION BY m ORDER BY "start", kind <> 'serve', live_start, live_end)),
mine AS (SELECT o.m, o.no, o.live_start, o.server_end, k.t, k.stroke_id, CASE WHEN {_KNOWN.format('k."end"')} THEN k."end" END AS "end", row_number() OVER (PARTITION BY o.m, o.no ORDER BY k.t, k.stroke_id) AS rn
  FROM ordered o JOIN strokes k ON k.m = o.m AND o.kind = 'serve' AND k.t > o.live_start AND k.t < o.next_start),
scan AS (
  SELECT m, no, 0::BIGINT AS rn, live_start AS last, {_OTHER.format('server_end')} AS want, 0::BIGINT AS n, FALSE AS stop, 0::BIGINT AS bad, NULL::BIGINT AS took FROM ordered WHERE kind = 'serve'
  UNION ALL
  SELECT x.m, x.no, x.rn, CASE WHEN x.act = 'take' THEN x.t ELSE x.last END, CASE WHEN x.act = 'take' THEN {_OTHER.format('x."end"')} ELSE x.want END, x.n + (x.act = 'take')::BIGINT,
    x.stop OR x.act = 'late', x.bad + (x.act IN ('late', 'bad'))::BIGINT, CASE WHEN x.act = 'take' THEN x.stroke_id END
  FROM (SELECT k.m, k.no, k.rn, k.t, k."end", k.stroke_id, s.last, s.want, s.n, s.stop, s.bad,
      CASE WHEN s.stop OR (s.n = 0 AND k.t <= k.live_start + 0.7) THEN 'pass' WHEN k."end" IS NULL THEN 'bad' WHEN k.t - s.last > CASE WHEN s.n = 0 THEN 4.5 ELSE 6 END THEN 'late'
        WHEN s.want IS NOT NULL AND s.want <> k."end" THEN 'bad' ELSE 'take' END AS act
    FROM scan s JOIN mine k ON k.m = s.m AND k.no = s.no AND k.rn = s.rn + 1) x),
walked AS (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY m, no ORDER BY rn DESC) = 1),
acted AS (SELECT o.* EXCLUDE (live_end), least(o.live_end, next_start, duration) AS live_end, CASE WHEN kind = 'serve' THEN w.n ELSE seed_n END AS accepted_actions, CASE WHEN kind = 'serve' THEN w.bad ELSE 0 END AS rejected_actions,
    greatest(live_start, CASE WHEN kind = 'serve' THEN w.last ELSE seed_last END) AS last_action FROM ordered o LEFT JOIN walked w ON w.m = o.m AND w.no = o.no),
ended AS (SELECT *, greatest(last_action, live_end) AS last_evidence,
    greatest("start", least(CASE WHEN transition IS NOT NULL THEN transition WHEN live_end > live_start THEN live_end ELSE least(next_start, last_action + 5) END, next_start, duration)) AS "end",
    CASE WHEN transition IS NOT NULL THEN 'calm_stretch' WHEN live_end > live_start THEN 'live_end' ELSE 'bounded_window' END AS source,
    CASE WHEN transition IS NOT NULL THEN 'high' WHEN live_end > live_start THEN 'medium' ELSE 'low' END AS confidence FROM acted),
tailed AS (SELECT *, greatest("end" - last_evidence, 0) AS tail FROM ended),
fin AS (SELECT *, CASE WHEN tail > 4 + 1e-6 THEN 'unexplained_tail' WHEN "end" - "start" < 2 THEN 'too_short' END AS dropped,
    (SELECT count(*) FROM strokes k WHERE k.m = tailed.m AND k.t BETWEEN tailed."start" AND tailed."end") AS raw_actions FROM tailed)"""

_PARTS = f"""{E},
rows AS (SELECT user_id // 4 AS m, event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id // 4 ORDER BY t, event_id) * 1.5::DOUBLE AS t, CASE WHEN side = 0 THEN 'near' ELSE 'far' END AS "end" FROM e),
strokes AS (SELECT m, event_id AS stroke_id, t, CASE WHEN value > 3 THEN "end" END AS "end" FROM rows WHERE event_type IN ('click', 'purchase')),
tries AS (SELECT m, event_id AS serve_id, t AS strike, t - 1 AS setup, "end", CASE WHEN value > 90 THEN 'left' WHEN value > 70 THEN 'right' END AS half, NULL::VARCHAR AS team, value / 120 AS score, value > 62 AS evidence, value > 75 AS accepted
  FROM rows WHERE event_type = 'signup' AND value > 50),
serves AS (SELECT * FROM tries s WHERE accepted OR (evidence AND score >= 0.52 AND EXISTS (SELECT 1 FROM strokes k WHERE k.m = s.m AND k."end" <> s."end" AND k.t > s.strike + 0.7 AND k.t <= s.strike + 4.5))),
calm AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY m ORDER BY t) > 4.5)::INT, 1) AS fresh FROM rows WHERE event_type IN ('view', 'error')),
spells AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY t ROWS UNBOUNDED PRECEDING) AS spell FROM calm),
bouts AS (SELECT m, min(t) AS "start", max(t) AS "end", CASE WHEN count(*) >= 5 THEN max(t) - 0.5 END AS transition FROM spells GROUP BY m, spell HAVING max(t) > min(t)),
durations AS (SELECT m, max(t) + 10 AS duration FROM rows GROUP BY m)"""
_POINTS = f"WITH RECURSIVE {_PARTS},{HYPOTHESES_SQL},{DECODED_SQL}"

_PLAYERS = f"""{E},
rows AS (SELECT user_id // 4 AS m, user_id AS actor_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) * 500 AS ms, CASE WHEN side = 0 THEN 'near' ELSE 'far' END AS "end" FROM e),
players AS (SELECT m, ms, actor_id, "end", event_type IN ('view', 'click') AS ready, round_even(value / 60, 4) >= 0.55 AS arm, round_even(value / 40, 4) >= 0.55 AS feet, value / 60 AS wrist_speed FROM rows),
acts AS (SELECT m, ms, actor_id, "end", event_type IN ('signup') AS serve FROM rows WHERE event_type IN ('signup', 'purchase') AND value > 130),
base AS (SELECT m, ms, count(*) AS visible, avg(ready::INT) AS ready_share, median(wrist_speed) AS wrist, bool_or(ready OR arm) AS support,
    {", ".join(f'''coalesce(bool_or("end" = '{e}'), FALSE) AS {e}_seen, coalesce(bool_or("end" = '{e}' AND ready), FALSE) AS {e}_ready, coalesce(bool_or("end" = '{e}' AND (arm OR ready AND feet)), FALSE) AS {e}_active''' for e in live.ENDS)}
  FROM players GROUP BY m, ms),
seen AS (SELECT *, visible >= 2 AND near_seen AND far_seen AS two_sided, visible >= 2 AND near_seen AND far_seen AND ready_share <= 0.3 AND wrist <= 1.75 AS relaxed FROM base)"""
_WINDOWS = f"""{_PLAYERS},
acts2 AS (SELECT *, lag(ms) OVER w AS p_ms, lag("end") OVER w AS p_end, row_number() OVER w AS event_no FROM acts WINDOW w AS (PARTITION BY m ORDER BY ms, NOT serve, actor_id)),
answered AS (SELECT a.*, (SELECT least(min(CASE WHEN CASE a."end" WHEN 'near' THEN far_active ELSE near_active END THEN f.ms END), list_sort(list(f.ms) FILTER (CASE a."end" WHEN 'near' THEN far_ready ELSE near_ready END))[2])
    FROM seen f WHERE f.m = a.m AND f.ms BETWEEN a.ms + 150 AND a.ms + 1750) AS answer FROM acts2 a),
w AS (SELECT f.m, f.ms, count(*) AS n_frames, avg(g.two_sided::INT) AS two_sided_share, avg(g.relaxed::INT) AS relaxed_share, min(CASE WHEN g.support THEN g.ms END) AS s0, max(CASE WHEN g.support THEN g.ms END) AS s1, min(CASE WHEN g.relaxed THEN g.ms END) AS calm,
    {", ".join(f"sum({e}_{x}::INT) / greatest(sum({e}_seen::INT), 1) AS {e}_{x}_share" for e in live.ENDS for x in ("ready", "active")).replace("sum(", "sum(g.")}
  FROM seen f JOIN seen g ON g.m = f.m AND g.ms BETWEEN f.ms - 1000 AND f.ms + 1000 GROUP BY f.m, f.ms),
v AS (SELECT w.m, w.ms, count(a.ms) AS n_events, count(a.ms) FILTER (a.serve) AS n_serves, count(a.ms) FILTER (NOT a.serve) AS n_strokes, count(*) FILTER (a.p_ms >= w.ms - 1000 AND a."end" <> a.p_end AND a.ms - a.p_ms BETWEEN 150 AND 1750) AS n_pairs,
    count(*) FILTER (a.answer <= w.ms + 1000) AS n_answers, min(a.ms) AS e0, max(a.ms) AS e1 FROM w LEFT JOIN answered a ON a.m = w.m AND a.ms BETWEEN w.ms - 1000 AND w.ms + 1000 GROUP BY w.m, w.ms),
x AS (SELECT *, two_sided_share >= 0.45 AS sided, two_sided_share >= 0.45 AND relaxed_share >= 0.6 AND n_events = 0 AND n_answers = 0 AS calm_now,
    list_filter([CASE WHEN n_serves > 0 THEN 'serve' END, CASE WHEN n_pairs > 0 THEN 'alternating_pair' END, CASE WHEN n_answers > 0 AND n_strokes > 0 THEN 'answered_stroke' END], lambda r: r IS NOT NULL) AS reasons FROM w JOIN v USING (m, ms)),
windows AS (SELECT m, ms, n_frames, two_sided_share, relaxed_share, near_ready_share, near_active_share, far_ready_share, far_active_share, n_events, n_serves, n_strokes, n_pairs, n_answers,
    least(s0, e0) AS evidence_start, greatest(s1, e1) AS evidence_end, CASE WHEN calm_now THEN calm END AS between_start, array_to_string(reasons, ',') AS seed_reasons,
    CASE WHEN len(reasons) > 0 THEN 'LIVE_SEED' WHEN sided AND near_ready_share >= 0.2 AND far_ready_share >= 0.2 AND ((near_active_share >= 0.2 AND far_active_share >= 0.2) OR n_events > 0 OR n_answers > 0) THEN 'LIVE_SUPPORT'
      WHEN calm_now THEN 'BETWEEN_POINTS' ELSE 'UNKNOWN' END AS state FROM x)"""

SQL = {
    "service_hypotheses": f"WITH RECURSIVE {_PARTS},{HYPOTHESES_SQL} SELECT * FROM hyp",
    "decoded_points": f"{_POINTS} SELECT * EXCLUDE (duration) FROM fin",
    "point_actions": f"""{_POINTS} SELECT k.m, k.no, s.n AS seq, CASE WHEN s.n = 1 THEN 'return' ELSE 'exchange' END AS role, k.t, k.stroke_id, k."end" FROM scan s JOIN mine k ON k.m = s.m AND k.no = s.no AND k.rn = s.rn WHERE s.took IS NOT NULL""",
    "decoded_quality": f"""{_POINTS},
kept AS (SELECT *, CASE WHEN lead("start") OVER w IS NOT NULL THEN greatest(lead("start") OVER w - "end", 0) END AS gap FROM fin WHERE dropped IS NULL WINDOW w AS (PARTITION BY m ORDER BY "start", "end", no)),
sums AS (SELECT m, count(k.no) AS n, coalesce(sum(k."end" - k."start") / any_value(d.duration), 0) AS retention, median(gap) AS median_gap, coalesce(avg(((kind = 'serve')::INT + accepted_actions <= 1)::INT), 0) AS bare_share, count(*) FILTER (round(tail, 3) > 4) AS violations
  FROM (SELECT DISTINCT m, duration FROM fin) d LEFT JOIN kept k USING (m) GROUP BY m),
told AS (SELECT *, coalesce(n >= 3 AND retention >= 0.9 AND median_gap <= 0.75, FALSE) AS tiled FROM sums)
SELECT * EXCLUDE (tiled), bare_share > 0.65 AS warned, violations > 0 OR tiled AS rejected, CASE WHEN violations > 0 THEN 'unbounded_tails' WHEN tiled THEN 'tiled_source' END AS reason FROM told""",
    "court_frames": f"WITH {_PLAYERS} SELECT * FROM seen",
    "court_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "seed_evidence": f"""WITH {_WINDOWS}, firsts AS (SELECT m, ms FROM windows QUALIFY state = 'LIVE_SEED' AND coalesce(lag(state) OVER (PARTITION BY m ORDER BY ms), '') <> 'LIVE_SEED'),
counts AS (SELECT f.m, f.ms, p."end", p.actor_id, count(*) AS observed, count(*) FILTER (ready) AS ready, count(*) FILTER (arm) AS arm_active, count(*) FILTER (feet) AS feet_active
  FROM firsts f JOIN players p ON p.m = f.m AND p.ms BETWEEN f.ms - 1000 AND f.ms + 1000 GROUP BY f.m, f.ms, p."end", p.actor_id)
SELECT *, ready / observed AS ready_share, arm_active / observed AS arm_active_share, feet_active / observed AS feet_active_share FROM counts""",
}
