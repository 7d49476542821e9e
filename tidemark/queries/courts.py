"""Courts from lines made from vectors: twenty lines a frame of 1280 by 720."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.plans import court_lines
from tidemark.queries.base import table

NEAR = {"angle": 20.0, "apart": 60.0, "overlap": 0.3, "length": 40.0}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    x, y = (e[0] + 0.5) * 1280, (e[1] + 0.5) * 720
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("frame"), "vec_id", x.alias("x1"), y.alias("y1"), (x + e[2] * 900).alias("x2"), (y + e[3] * 400).alias("y2"))


def court_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer corners of each frame's lines, and whether they look like the court that is followed."""
    found = court_lines.outer_corners(_lines(spark, sf_dir), ["frame"])
    corner = {c: (F.col(f"{c}_x"), F.col(f"{c}_y")) for c in court_lines.CORNERS}
    return found.select("frame", *(F.round(f"{c}_{axis}", 4).alias(f"{c}_{axis}") for c in corner for axis in "xy"), court_lines.plausible(F.lit(1280.0), F.lit(720.0), corner).alias("plausible"))


def line_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that another line of their frame, one of the other half of it, supports."""
    rows = _lines(spark, sf_dir)
    seen = rows.filter("vec_id % 20 >= 10").select("frame", F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    return court_lines.supported(rows.filter("vec_id % 20 < 10"), seen, ["frame"], "vec_id", **NEAR).select("frame", "vec_id")


def line_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest lines of each frame, no two with left ends within 250 pixels, six at most."""
    rows = _lines(spark, sf_dir).withColumn("long", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return folds.leaders(rows, ["frame"], ["x1", "y1"], "long", "vec_id", 250.0, 6)


QUERIES = {f.__name__: f for f in (court_corners, line_support, line_leaders)}

_LINES = """l0 AS (SELECT vec_id // 20 AS frame, vec_id, (embedding[1]::DOUBLE + 0.5::DOUBLE) * 1280 AS x1, (embedding[2]::DOUBLE + 0.5::DOUBLE) * 720 AS y1, embedding[3]::DOUBLE * 900 AS dx, embedding[4]::DOUBLE * 400 AS dy FROM embeddings),
l AS (SELECT *, x1 + dx AS x2, y1 + dy AS y2 FROM l0)"""


def _meet(p: str, q: str, axis: str) -> str:
    c = f"(({p}.x2 - {p}.x1) * ({q}.y2 - {q}.y1) - ({p}.y2 - {p}.y1) * ({q}.x2 - {q}.x1))"
    at = f"((({q}.x1 - {p}.x1) * ({q}.y2 - {q}.y1) - ({q}.y1 - {p}.y1) * ({q}.x2 - {q}.x1)) / {c})"
    return f"CASE WHEN abs({c}) >= 1e-9 THEN {p}.{axis}1 + {at} * ({p}.{axis}2 - {p}.{axis}1) END AS {p}_{q}_{axis}"


_PAIRS = [c.split("_") for c in court_lines.CORNERS]
SQL = {
    "court_corners": f"""WITH {_LINES}, k AS (SELECT frame, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS line, (y1 + y2) / 2 AS y, (x1 + x2) / 2 AS x, least(abs(degrees(atan2(y2 - y1, x2 - x1))), 180 - abs(degrees(atan2(y2 - y1, x2 - x1)))) <= 35 AS lv FROM l),
 g AS (SELECT frame, arg_max(line, y) FILTER (lv) AS near, arg_min(line, y) FILTER (lv) AS far, arg_min(line, x) FILTER (NOT lv) AS "left", arg_max(line, x) FILTER (NOT lv) AS "right" FROM k GROUP BY frame HAVING count(*) FILTER (lv) >= 2 AND count(*) FILTER (NOT lv) >= 2),
 c AS (SELECT frame, {", ".join(_meet(p, q, a) for p, q in _PAIRS for a in "xy").replace("left.", '"left".').replace("right.", '"right".')} FROM g)
 SELECT frame, {", ".join(f"round({p}_{q}_{a}, 4) AS {p}_{q}_{a}" for p, q in _PAIRS for a in "xy")},
  {" AND ".join(f"{p}_{q}_x BETWEEN -0.03 * 1280 AND 1279 + 0.03 * 1280" for p, q in _PAIRS)} AND ((near_left_y + near_right_y) / 2 >= 0.78 * 720 OR abs((near_left_x + near_right_x) / 2 - (far_left_x + far_right_x) / 2) <= 0.08 * 1280) AS plausible
 FROM c WHERE {" AND ".join(f"{p}_{q}_x IS NOT NULL" for p, q in _PAIRS)}""",
    "line_leaders": f"""WITH RECURSIVE {_LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY sqrt(dx * dx + dy * dy) DESC, vec_id) AS rn FROM l),
 r AS (SELECT DISTINCT frame, 0::BIGINT AS rn, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM o
  UNION ALL
  SELECT o.frame, o.rn, CASE WHEN len(kept) >= 6 OR len(list_filter(kept, lambda k: sqrt((k.x - o.x1) * (k.x - o.x1) + (k.y - o.y1) * (k.y - o.y1)) <= 250)) > 0 THEN kept ELSE list_append(kept, {{'id': o.vec_id, 'x': o.x1, 'y': o.y1}}) END
  FROM r JOIN o ON o.frame = r.frame AND o.rn = r.rn + 1),
 z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY frame ORDER BY rn DESC) = 1)
 SELECT frame, unnest(kept).id AS vec_id, unnest(range(1, len(kept) + 1))::INT AS rank FROM z""",
    "line_support": f"""WITH {_LINES}, p AS (SELECT a.frame, a.vec_id, sqrt(a.dx * a.dx + a.dy * a.dy) AS n, sqrt(b.dx * b.dx + b.dy * b.dy) AS m, abs(a.dx * b.dx + a.dy * b.dy) AS dot, (b.x1 + b.dx / 2 - a.x1) * -a.dy + (b.y1 + b.dy / 2 - a.y1) * a.dx AS side,
   (b.x1 - a.x1) * a.dx + (b.y1 - a.y1) * a.dy AS s, (b.x2 - a.x1) * a.dx + (b.y2 - a.y1) * a.dy AS t FROM l a JOIN l b ON a.frame = b.frame AND a.vec_id % 20 < 10 AND b.vec_id % 20 >= 10)
 SELECT DISTINCT frame, vec_id FROM p WHERE n >= 1 AND m >= 40 AND degrees(acos(least(dot / (n * m), 1))) <= 20 AND abs(side) / n <= 60 AND greatest(least(n, greatest(s, t) / n) - greatest(least(s, t) / n, 0), 0) / n >= 0.3""",
}
