"""People on a court, tasks for annotators and reports of serves, over boxes made from vectors and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import court, names
from tidemark.operators import islands, labelling
from tidemark.plans import decode
from tidemark.queries import points
from tidemark.queries.base import HOUR, E, events, sessions_sql, table


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box a vector in a frame of 1280 by 720; forty a match, eight a frame."""
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    x0, y0 = F.greatest(F.least((e[0] + 0.5) * 900, F.lit(1200.0)), F.lit(0.0)), F.greatest(F.least((e[1] + 0.5) * 450, F.lit(680.0)), F.lit(0.0))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 40).alias("m"), (F.floor(F.col("vec_id") / 8) % 5).cast("double").alias("time_s"), x0.alias("x0"), y0.alias("y0"), (F.abs(e[2]) * 120).alias("w"), (F.abs(e[3]) * 240).alias("h"))
    return rows.select("vec_id", "m", "time_s", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"))


def court_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each box stands, whether that is on the apron of a court of twice its length in the frame, the slot it suggests, and the box for the pose model."""
    b = _boxes(spark, sf_dir)
    box, size = [F.col(c) for c in ("x0", "y0", "x1", "y1")], (F.col("width"), F.col("height"))
    rows = b.withColumn("o", court.observation(box, *size))
    shares = [c / s for c, s in zip(box, (*size, *size), strict=True)]
    x, y = F.col("o.foot_x") * 20 - 4, F.col("o.foot_y") * 40 - 8
    rows = rows.withColumn("wide", court.widened(shares, *size))
    return rows.select("vec_id", "o.*", court.on_apron(x, y, F.col("o.area")).alias("on_apron"), court.suggested_slot(F.col("o.foot_x"), F.col("o.foot_y"), F.lit(0.45), F.lit(None).cast("double"), F.col("vec_id") % 2 == 0).alias("slot"), F.col("wide").isNotNull().alias("usable"), F.round("wide.left", 6).alias("wide_left"), F.round("wide.low", 6).alias("wide_low"))


def player_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve crops of each match at most, from inside its region."""
    b = _boxes(spark, sf_dir)
    regions = b.filter("m % 3 <> 0").select("m").distinct().select("m", F.lit(0.1).alias("left"), F.lit(0.2).alias("top"), F.lit(0.9).alias("right"), F.lit(0.9).alias("low"), (F.col("m") % 2 == 0).alias("doubles"))
    return labelling.player_crops(b, regions, ["m"], 12).select("m", "task", "time_s", "crop.*", "suggested")


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six times, in hours, to look at each user's sessions of the first kinds of event."""
    e = events(spark, sf_dir)
    own = islands.sessions(e.filter("event_type = 'signup' and value > 40"), ["user_id"], "t", HOUR, "event_id")
    segments = own.select("user_id", (F.col("start") / HOUR).alias("start"), (F.col("end") / HOUR + 0.5).alias("end"))
    matches = e.groupBy("user_id").agg(F.max(F.col("t") / HOUR).alias("duration"))
    return labelling.frame_times(matches, segments, ["user_id"], 6)


def serve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match: proposals, confirmed and rejected ones, and the confirmed times."""
    serves, strokes, _, _ = points._parts(spark, sf_dir)
    rows = decode.promoted(serves, strokes, ["m"])
    out = rows.groupBy("m").agg(F.count("*").alias("proposals"), F.count_if("accepted").alias("confirmed"), F.array_sort(F.collect_list(F.when(F.col("accepted"), F.bround("strike", 3)))).alias("times"))
    return out.select("m", "proposals", "confirmed", (F.col("proposals") - F.col("confirmed")).alias("rejected"), F.array_join(F.transform("times", lambda x: F.format_string("%.3f", x)), ",").alias("times"))


def points_after_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept points that begin after the first minute; what was measured before stays as it was."""
    return decode.after_intro(points._decoded(spark, sf_dir)[0], 60.0).select("m", "no", "kind", "start", "end", "classification")


_FIELDS = {0: ["player", "quality", "colour"], 1: ["is_serve", "server", "end", "notes", "player"]}
_VALUES = ["P1", "clear", "near", "yes", "", "unknown", "P2"]


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from documents, with what is stored of each and why the others are refused; a roster for every other job."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    serve = F.col("doc_id") % 2 == 1
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (by % len(names)).cast("int"))
    field = F.when(serve, pick(_FIELDS[1], F.col("n_chars"))).otherwise(pick(_FIELDS[0], F.col("n_chars")))
    values = d.select(F.floor(F.col("doc_id") / 50).alias("job"), F.col("doc_id").alias("task"), F.when(serve, "serve_motion").otherwise("player_identity").alias("kind"), field.alias("field"), pick(_VALUES, F.floor(F.col("n_chars") / 7)).alias("value"))
    roster = values.filter("job % 2 = 0").select("job").distinct().withColumn("id", F.explode(F.array(F.lit("P1"), F.lit("P3"))))
    return labelling.checked_labels(values.filter("field is not null"), roster)


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file that comes from each page would be called, and whether that could be an id of a roster."""
    name = names.safe_name(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), names.is_roster_id(name).alias("roster_id"))


QUERIES = {f.__name__: f for f in (court_people, player_crops, frame_times, serve_summary, points_after_intro, label_check, safe_names)}

_BOXES = """b0 AS (SELECT vec_id, vec_id // 40 AS m, (vec_id // 8 % 5)::DOUBLE AS time_s, greatest(least((embedding[1]::DOUBLE + 0.5::DOUBLE) * 900, 1200.0::DOUBLE), 0.0::DOUBLE) AS x0, greatest(least((embedding[2]::DOUBLE + 0.5::DOUBLE) * 450, 680.0::DOUBLE), 0.0::DOUBLE) AS y0,
  abs(embedding[3]::DOUBLE) * 120 AS w, abs(embedding[4]::DOUBLE) * 240 AS h FROM embeddings),
b AS (SELECT vec_id, m, time_s, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM b0)"""

_WORDS = ", ".join(f"('{k}', '{f}', '{w}')" for (k, f), ws in labelling.WORDS.items() for w in ws)
_KNOWN = ", ".join(f"('{k}', '{f}')" for k, f in sorted({*labelling.WORDS, *labelling.ROSTER, labelling.NOTES}))
SQL = {
    "label_check": f"""WITH v AS (SELECT doc_id // 50 AS job, doc_id AS task, CASE WHEN doc_id % 2 = 1 THEN 'serve_motion' ELSE 'player_identity' END AS kind,
   CASE WHEN doc_id % 2 = 1 THEN {_FIELDS[1]}[n_chars % 5 + 1] ELSE {_FIELDS[0]}[n_chars % 3 + 1] END AS field, {_VALUES}[n_chars // 7 % 7 + 1] AS value FROM documents),
 e AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM (VALUES {_KNOWN}) k(kind, field) WHERE k.kind = v.kind AND k.field = v.field) THEN 'unknown_field' WHEN coalesce(value, '') = '' OR field = 'notes' THEN NULL
   WHEN EXISTS (SELECT 1 FROM (VALUES {_WORDS}) w(kind, field, word) WHERE w.kind = v.kind AND w.field = v.field AND w.word = v.value) OR (field IN ('player', 'server') AND job % 2 = 0 AND value IN ('P1', 'P3')) THEN NULL ELSE 'unknown_value' END AS error FROM v WHERE field IS NOT NULL)
 SELECT *, CASE WHEN error IS NULL AND value <> '' THEN value END AS clean FROM e""",
    "safe_names": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '([^/]*)/*$', 1), '[^\p{L}\p{N}._\- ]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM pages),
 q AS (SELECT page_id, CASE WHEN n = '' THEN 'upload.mp4' ELSE n END AS name FROM p) SELECT page_id, name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_.-]{0,49}') AS roster_id FROM q""",
    "court_people": f"""WITH {_BOXES}, o AS (SELECT *, (x0 + x1) / 2560.0::DOUBLE AS foot_x, y1 / 720.0::DOUBLE AS foot_y, (x1 - x0) * (y1 - y0) / (1280.0::DOUBLE * 720.0::DOUBLE) AS area FROM b),
 s AS (SELECT *, x0 / 1280.0::DOUBLE AS l, x1 / 1280.0::DOUBLE AS r, y0 / 720.0::DOUBLE AS t, y1 / 720.0::DOUBLE AS d FROM o),
 p AS (SELECT *, greatest(l - 0.12::DOUBLE * (r - l), 0.0::DOUBLE) * 1280 AS wl, least(r + 0.12::DOUBLE * (r - l), 1.0::DOUBLE) * 1280 AS wr, greatest(t - 0.07::DOUBLE * (d - t), 0.0::DOUBLE) * 720 AS wt, least(d + 0.06::DOUBLE * (d - t), 1.0::DOUBLE) * 720 AS wd FROM s),
 q AS (SELECT *, wr - wl >= 4 AND wd - wt >= 8 AS usable FROM p)
 SELECT vec_id, foot_x, foot_y, area, foot_x * 20 - 4 BETWEEN -1.5 AND 12.47 AND foot_y * 40 - 8 BETWEEN -3 AND 26.77 AND area > 0 AS on_apron,
  CASE WHEN vec_id % 2 = 0 THEN CASE WHEN foot_y >= 0.5 THEN CASE WHEN foot_x < 0.45 THEN 'P1' ELSE 'P2' END WHEN foot_x < 0.45 THEN 'P3' ELSE 'P4' END WHEN foot_y >= 0.5 THEN 'P1' ELSE 'P2' END AS slot,
  usable, CASE WHEN usable THEN round(wl, 6) END AS wide_left, CASE WHEN usable THEN round(wd, 6) END AS wide_low FROM q""",
    "player_crops": f"""WITH {_BOXES}, f AS (SELECT *, (x0 + x1) / 2 / 1280.0::DOUBLE AS fx, y1 / 720.0::DOUBLE AS fy, greatest(trunc(x0 - 0.12::DOUBLE * (x1 - x0)), 0)::BIGINT AS "left", greatest(trunc(y0 - 0.10::DOUBLE * (y1 - y0)), 0)::BIGINT AS top,
   least(trunc(x1 + 0.12::DOUBLE * (x1 - x0)), 1280)::BIGINT AS "right", least(trunc(y1 + 0.10::DOUBLE * (y1 - y0)), 720)::BIGINT AS low FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY time_s, (x1 - x0) * (y1 - y0) DESC, x0 DESC, y0 DESC, x1 DESC, y1 DESC) - 1 AS task FROM f
   WHERE "right" - "left" >= 12 AND low - top >= 24 AND (m % 3 = 0 OR (fx BETWEEN 0.1 AND 0.9 AND fy BETWEEN 0.2 AND 0.9)))
 SELECT m, task, time_s, "left", top, "right", low, CASE WHEN m % 3 <> 0 AND m % 2 = 0 THEN CASE WHEN fy >= 0.55 THEN CASE WHEN fx < 0.5 THEN 'P1' ELSE 'P2' END WHEN fx < 0.5 THEN 'P3' ELSE 'P4' END
   WHEN fy >= CASE WHEN m % 3 = 0 THEN 0.5 ELSE 0.55 END THEN 'P1' ELSE 'P2' END AS suggested FROM k WHERE task < 12""",
    "frame_times": f"""WITH {E}, {sessions_sql("user_id", HOUR, "event_type = 'signup' AND value > 40")},
 g AS (SELECT user_id, "start" / {HOUR}.0::DOUBLE AS a, "end" / {HOUR}.0::DOUBLE + 0.5::DOUBLE AS z, row_number() OVER (PARTITION BY user_id ORDER BY "start") - 1 AS place, count(*) OVER (PARTITION BY user_id) AS k FROM s),
 u AS (SELECT user_id, max(t / {HOUR}.0::DOUBLE) AS duration FROM e GROUP BY user_id), n AS (SELECT u.*, i, coalesce(k, 0) AS k FROM u CROSS JOIN range(6) r(i) LEFT JOIN (SELECT DISTINCT user_id, k FROM g) USING (user_id)),
 x AS (SELECT n.*, a, z FROM n LEFT JOIN g ON g.user_id = n.user_id AND place = CASE WHEN n.k >= 6 THEN round_even(i * (n.k - 1) / 5.0::DOUBLE, 0)::BIGINT WHEN i < n.k THEN i ELSE (i - n.k) % n.k END),
 y AS (SELECT user_id, i, CASE WHEN k = 0 THEN duration * (i + 1) / 7 WHEN k >= 6 OR i < k THEN (a + z) / 2 ELSE least(z - 0.1::DOUBLE, a + fmod(0.3::DOUBLE + 0.5::DOUBLE * ((i - k) // k), greatest(z - a, 0.3::DOUBLE))) END AS time_s FROM x)
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY time_s, i) - 1 AS no, time_s FROM y WHERE time_s IS NOT NULL""",
    "serve_summary": f"""WITH {points._PARTS}, c AS (SELECT m, count(*) AS confirmed, string_agg(printf('%.3f', round_even(strike, 3)), ',' ORDER BY strike) AS times FROM serves GROUP BY m)
 SELECT t.m, t.proposals, coalesce(confirmed, 0) AS confirmed, t.proposals - coalesce(confirmed, 0) AS rejected, coalesce(times, '') AS times FROM (SELECT m, count(*) AS proposals FROM tries GROUP BY m) t LEFT JOIN c USING (m)""",
    "points_after_intro": f'{points._POINTS} SELECT m, no, kind, "start", "end", classification FROM fin WHERE dropped IS NULL AND "start" >= 60',
}
