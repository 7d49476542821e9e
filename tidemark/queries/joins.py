"""As-of, band and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geometry import box_iou
from tidemark.functions.intervals import overlap
from tidemark.operators import islands, ranges, spatial
from tidemark.queries.base import DAY, HOUR, MINUTE, E, events, sessions_sql, table


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    probes = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    samples = e.filter("event_type = 'view'").select("user_id", "t", "value")
    return ranges.asof(probes, samples, ["user_id"], "t", "value", 48 * HOUR)


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir)


def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.interpolated(_asof(spark, sf_dir), "t", 24 * HOUR).select("event_id", "value_at", "how", "nearest_time")


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipped part with the last earlier order of any customer with the same order key modulo 100."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), day("l_shipdate").alias("day")).distinct()
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("k"), day("o_orderdate").alias("day"), F.col("o_orderkey").alias("key"))
    out = ranges.asof(lines, orders, ["k"], "day", "key", 400)
    return out.select("k", "day", "prev_time", F.col("prev_value").alias("prev_key"))


def _band(spark: SparkSession, sf_dir: str, anti: bool) -> DataFrame:
    e = events(spark, sf_dir)
    hits = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("hit"))
    out = ranges.band_semi(e.filter("event_type = 'click'"), "event_id", hits, ["user_id"], "hit", F.col("t") + 30 * MINUTE, F.col("t") + 12 * HOUR, 12 * HOUR, open_low=True, anti=anti)
    return out.select("event_id", "user_id", "t")


def band_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir, anti=False)


def band_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _band(spark, sf_dir, anti=True)


def band_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per error, the events of all users within ten minutes of it, both ends included."""
    e = events(spark, sf_dir).withColumn("all", F.lit(1))
    errors = e.filter("event_type = 'error'").select("all", F.col("event_id").alias("error_id"), "t")
    found = ranges.band_totals(e.select("all", "t", "side"), errors, ["all"], "t", -10 * MINUTE, 10 * MINUTE, HOUR, sums={"n_side1": F.col("side")})
    return found.groupBy("error_id").agg(F.sum("n").alias("n"), F.sum("n_side1").cast("long").alias("n_side1"))


def first_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per click, the first event of the other side 9 to 105 minutes later."""
    e = events(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "t", (1 - F.col("side")).alias("side"))
    found = ranges.band_totals(e.select("side", "t", "event_id"), clicks, ["side"], "t", 9 * MINUTE, 105 * MINUTE, 4 * HOUR, first="event_id")
    return found.groupBy("click_id").agg(F.min("_first")["v"].alias("response_id"), F.sum("n").alias("n"))


def _intervals(spark: SparkSession, sf_dir: str, kind: str, p: str) -> DataFrame:
    own = islands.sessions(events(spark, sf_dir).filter(F.col("event_type") == kind), ["event_type"], "t", HOUR, "event_id", bucket=F.floor(F.col("t") / DAY))
    return own.select(F.lit(1).alias("all"), F.col("session").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))


def _pairs(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return ranges.overlap_pairs(_intervals(spark, sf_dir, "click", "a"), _intervals(spark, sf_dir, "view", "b"), ["all"], 3 * HOUR, strict)


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections of click sessions and view sessions that share more than a point."""
    both = _pairs(spark, sf_dir, strict=True)
    return both.select("a_id", "b_id", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


def interval_argmax_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view session that overlaps each click session most; then the longer, then the earlier one."""
    size = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    key = F.struct(size.alias("o"), (F.col("b_end") - F.col("b_start")).alias("d"), (-F.col("b_start")).alias("s"))
    return _pairs(spark, sf_dir).groupBy("a_id").agg(F.max_by("b_id", key).alias("b_id"), F.max(size).alias("overlap"), F.count("*").alias("n"))


def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click sessions that no view session overlaps by more than five minutes."""
    a = _intervals(spark, sf_dir, "click", "a")
    size = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return a.join(_pairs(spark, sf_dir).filter(size > 5 * MINUTE).select("a_id").distinct(), "a_id", "left_anti").drop("all")


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per view session, the longest click session within half an hour of its bounds and the number of those."""
    pad = 30 * MINUTE
    wide = _intervals(spark, sf_dir, "view", "b").withColumns({"b_start": F.col("b_start") - pad, "b_end": F.col("b_end") + pad})
    both = ranges.overlap_pairs(_intervals(spark, sf_dir, "click", "a"), wide, ["all"], 3 * HOUR).filter("a_start >= b_start and a_end <= b_end")
    return both.groupBy("b_id").agg(F.max_by("a_id", F.struct(F.col("a_end") - F.col("a_start"), -F.col("a_start"))).alias("a_id"), F.count("*").alias("n"))


def spatial_iou_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts against boxes of suppliers of one frame: the best of at least 0.12 overlap over union."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 97).alias("frame"), (F.col("p_size") % 13).cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), (F.col("s_suppkey") % 97).alias("frame"), (F.col("s_suppkey") % 11).cast("double").alias("u"), (F.col("s_suppkey") % 5).cast("double").alias("v"))
    p = p.select("part", "frame", "x", "y", (F.col("x") + 5).alias("x2"), (F.col("y") + 4).alias("y2"))
    s = s.select("supp", "frame", "u", "v", (F.col("u") + 6).alias("u2"), (F.col("v") + 5).alias("v2"))
    a_box, b_box = ("x", "y", "x2", "y2"), ("u", "v", "u2", "v2")
    best = spatial.best_boxes(p, s, ["frame"], a_box, b_box, "supp", box_iou([F.col(c) for c in a_box], [F.col(c) for c in b_box]), 0.12, "iou")
    return best.groupBy("part").agg(F.max_by("supp", F.struct("iou", -F.col("supp"))).alias("supp"), F.max("iou").alias("iou"))


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users looked up in customer, nation and region, with defaults where there is none: counts by region."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    e = events(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return e.groupBy(F.coalesce("r_name", F.lit("none")).alias("region"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (asof_nearest, asof_interpolate, asof_orders, band_semi_join, band_anti_join, band_count, first_response, interval_overlap_join, interval_argmax_join, interval_anti_join, interval_containment, spatial_iou_argmax, enriched_events)}

_ASOF = f"""WITH {E}, p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'),
 v AS (SELECT user_id, t AS vt, max(value) AS vv FROM e WHERE event_type = 'view' GROUP BY 1, 2),
 j AS (SELECT p.*, a.vt AS prev_time, a.vv AS prev_value, b.vt AS next_time, b.vv AS next_value
   FROM p ASOF LEFT JOIN v a ON p.user_id = a.user_id AND p.t >= a.vt ASOF LEFT JOIN v b ON p.user_id = b.user_id AND p.t <= b.vt)"""
_BAND = f"WITH {E} SELECT event_id, user_id, t FROM e WHERE event_type = 'click' AND {{}} EXISTS (SELECT 1 FROM e h WHERE h.event_type = 'purchase' AND h.user_id = e.user_id AND h.t > e.t + {30 * MINUTE} AND h.t <= e.t + {12 * HOUR})"
_AB = f"""WITH {E}, {sessions_sql("event_type", HOUR)}, a AS (SELECT session AS a_id, "start" AS a_start, "end" AS a_end FROM s WHERE event_type = 'click'),
 b AS (SELECT session AS b_id, "start" AS b_start, "end" AS b_end FROM s WHERE event_type = 'view'),
 ab AS (SELECT *, greatest(least(a_end, b_end) - greatest(a_start, b_start), 0)::DOUBLE AS o FROM a JOIN b ON a_start <= b_end AND b_start <= a_end)"""

SQL = {
    "asof_nearest": f"{_ASOF} SELECT * FROM j",
    "asof_interpolate": f"""{_ASOF}, k AS (SELECT *, t - prev_time AS back, next_time - t AS ahead, coalesce(t - prev_time <= {24 * HOUR}, FALSE) AS l, coalesce(next_time - t <= {24 * HOUR}, FALSE) AS r FROM j)
 SELECT event_id, CASE WHEN back = 0 THEN prev_value WHEN l AND r THEN prev_value + (next_value - prev_value) * (back::DOUBLE / (back + ahead)) WHEN l THEN prev_value WHEN r THEN next_value END AS value_at,
 CASE WHEN back = 0 THEN 'exact' WHEN l AND r THEN 'blend' WHEN l THEN 'prev' WHEN r THEN 'next' ELSE 'none' END AS how,
 CASE WHEN l AND (NOT r OR back <= ahead) THEN prev_time WHEN r THEN next_time END AS nearest_time FROM k""",
    "asof_orders": """WITH l AS (SELECT DISTINCT l_orderkey % 100 AS k, epoch(l_shipdate)::BIGINT // 86400 AS day FROM lineitem),
 o AS (SELECT o_orderkey % 100 AS k, epoch(o_orderdate)::BIGINT // 86400 AS day, max(o_orderkey) AS key FROM orders GROUP BY 1, 2)
 SELECT l.k, l.day, o.day AS prev_time, o.key AS prev_key FROM l ASOF LEFT JOIN o ON l.k = o.k AND l.day >= o.day""",
    "band_semi_join": _BAND.format(""),
    "band_anti_join": _BAND.format("NOT"),
    "band_count": f"WITH {E} SELECT a.event_id AS error_id, count(*) AS n, sum(b.side)::BIGINT AS n_side1 FROM e a JOIN e b ON b.t BETWEEN a.t - {10 * MINUTE} AND a.t + {10 * MINUTE} WHERE a.event_type = 'error' GROUP BY 1",
    "first_response": f"WITH {E} SELECT a.event_id AS click_id, arg_min(b.event_id, (b.t, b.event_id)) AS response_id, count(*) AS n FROM e a JOIN e b ON b.side = 1 - a.side AND b.t BETWEEN a.t + {9 * MINUTE} AND a.t + {105 * MINUTE} WHERE a.event_type = 'click' GROUP BY 1",
    "interval_overlap_join": f'{_AB} SELECT a_id, b_id, greatest(a_start, b_start) AS "start", least(a_end, b_end) AS "end" FROM ab WHERE o > 0',
    "interval_argmax_join": f"{_AB} SELECT a_id, arg_max(b_id, (o, b_end - b_start, -b_start)) AS b_id, max(o) AS overlap, count(*) AS n FROM ab GROUP BY a_id",
    "interval_anti_join": f"{_AB} SELECT * FROM a WHERE a_id NOT IN (SELECT a_id FROM ab WHERE o > {5 * MINUTE})",
    "interval_containment": f"{_AB} SELECT b_id, arg_max(a_id, (a_end - a_start, -a_start)) AS a_id, count(*) AS n FROM a JOIN b ON a_start >= b_start - {30 * MINUTE} AND a_end <= b_end + {30 * MINUTE} GROUP BY b_id",
    "spatial_iou_argmax": """WITH p AS (SELECT p_partkey AS part, p_partkey % 97 AS frame, (p_size % 13)::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS y FROM part),
 s AS (SELECT s_suppkey AS supp, s_suppkey % 97 AS frame, (s_suppkey % 11)::DOUBLE AS u, (s_suppkey % 5)::DOUBLE AS v FROM supplier),
 i AS (SELECT part, supp, greatest(least(x + 5, u + 6) - greatest(x, u), 0) * greatest(least(y + 4, v + 5) - greatest(y, v), 0) AS inner_area FROM p JOIN s USING (frame)),
 q AS (SELECT *, inner_area / (20 + 30 - inner_area) AS iou FROM i)
 SELECT part, arg_max(supp, (iou, -supp)) AS supp, max(iou) AS iou FROM q WHERE iou >= 0.12 GROUP BY part""",
    "enriched_events": """SELECT coalesce(r_name, 'none') AS region, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events
 LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
