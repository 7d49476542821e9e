"""Frame profiles, formats, vectors, geometry, text counts and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, vectors
from tidemark.operators import evaluation, identity, islands
from tidemark.queries.base import HOUR, MINUTE, E, events, sessions_sql, table
from tidemark.sources.scratch import written


def frame_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of six hours on the full grid: the last event of each user counts; empty frames are there too."""
    e = events(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / (6 * HOUR)))
    last = e.groupBy("frame", "user_id").agg(F.max_by(F.struct("event_type", "value", "side"), F.struct("t", "event_id")).alias("r")).select("frame", "user_id", "r.*")
    found = last.groupBy("frame").agg(
        F.count("*").alias("users"), F.sum((F.col("event_type") == "view").cast("long")).alias("ready"), F.max("value").alias("top"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.75)).alias("q75"), F.array_sort(F.collect_set("side")).alias("sides"),
    )
    ends = found.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi")).alias("frame"))
    out = grid.join(found, "frame", "left").withColumns({"users": F.coalesce("users", F.lit(0)), "ready": F.coalesce("ready", F.lit(0))})
    return out.withColumn("ready_share", F.when(F.col("users") > 0, F.col("ready") / F.col("users")).otherwise(0.0))


def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of four fixed states, zeros included."""
    e = events(spark, sf_dir)
    count = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    return e.groupBy("side").agg(*map(count, ("signup", "click", "view", "refund")))


def format_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, whether an hour usually holds two or more active users of each side (doubles) or not."""
    e = events(spark, sf_dir)
    hours = e.groupBy(F.floor(F.col("t") / (24 * HOUR)).alias("day"), F.floor(F.col("t") / HOUR).alias("hour")).agg(
        F.countDistinct(F.when(F.col("side") == 0, F.col("user_id"))).alias("near"), F.countDistinct(F.when(F.col("side") == 1, F.col("user_id"))).alias("far")
    )
    out = hours.groupBy("day").agg(F.count("*").alias("hours"), F.count_if((F.col("near") >= 1) & (F.col("far") >= 1)).alias("both"), F.count_if((F.col("near") >= 2) & (F.col("far") >= 2)).alias("pairs"))
    share = F.col("pairs") / F.greatest("both", F.lit(1))
    kind = F.when(F.col("both") == 0, "unknown").when(share >= 0.25, "doubles").otherwise("singles")
    return out.withColumns({"format": kind, "confidence": F.least(F.greatest(F.abs(share - 0.25) * 4, F.lit(0.0)), F.lit(1.0))})


def dominant_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return identity.dominant_side(rows, ["n_regionkey"], F.col("c_custkey") % 2)


def appearance_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.median_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.select("label", F.posexplode("centre").alias("i", "x"))


#: Centres that a vector is compared with at once, and that are sent to every task.
CENTRES = 1024


def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the label whose centre is nearest. Centres go in blocks; only a single block of them is broadcast."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    centres = written(identity.median_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding"))
    blocks = -(-centres.count() // CENTRES) or 1
    every = centres.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("label", "centre")).alias("c"))
    rows = x.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    both = rows.join(F.broadcast(every) if blocks == 1 else every, "block")
    best = F.array_min(F.transform("c", lambda c: F.struct(F.round(vectors.cosine_distance(F.col("v"), c["centre"]), 9).alias("d"), c["label"].alias("l"))))
    both = both.select("vec_id", best.alias("best"))
    if blocks > 1:
        both = both.groupBy("vec_id").agg(F.min("best").alias("best"))
    return both.select("vec_id", F.col("best.l").alias("label"), F.col("best.d").alias("distance"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of tracks: eighty a match, four a track, four a frame; five people, told apart by a long part of the appearance."""
    v, x = F.col("vec_id"), F.transform("embedding", lambda e: e.cast("double"))
    own = v % 80
    track = F.floor(own / 4)
    person = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == track % 5, 3.0).otherwise(0.0))
    end = F.when((track % 2 == 0) != ((F.col("label") == 0) & (own % 4 == 0)), "near").otherwise("far")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 80).alias("match_id"), ((own % 20) * 500).alias("ms"), track.alias("track"), end.alias("end"), F.abs(x[0]).alias("area"), x[1].alias("court_x"), F.concat(person, F.slice(x, 3, 20)).alias("appearance"))


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = written(_observations(spark, sf_dir))
    formats = seen.select("match_id").distinct().withColumn("per_end", F.when(F.col("match_id") % 2 == 0, 1).otherwise(2))
    return seen, identity.assign_identities(seen, formats, "match_id")


def identity_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks assigned to the two or four players of each match."""
    return _assigned(spark, sf_dir)[1]


def inspection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that show each player best."""
    seen, found = _assigned(spark, sf_dir)
    return identity.inspection_rows(seen, written(found), "match_id")


def public_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players of each match with their tracks and thumbnails."""
    seen, found = _assigned(spark, sf_dir)
    found = written(found)
    return identity.public_roster(found, identity.inspection_rows(seen, found, "match_id"), "match_id")


def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks that stand for the players of each match."""
    seen = _observations(spark, sf_dir)
    formats = seen.select("match_id").distinct().withColumn("per_end", F.when(F.col("match_id") % 2 == 0, 1).otherwise(2))
    return identity.anchors(seen, identity.profiles(seen, "match_id"), formats, "match_id")


def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an annotation by its index fields, by its numbered headings where it has none; each document is
    written as one of the two forms by its language, a point a sentence."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    numbered = F.transform(F.split("text", r"\. "), lambda s, i: F.concat(F.when(F.col("lang") == "en", F.lit('"point_index": ')).otherwise(F.lit("  point ")), i.cast("string"), F.lit(": "), s))
    note = F.array_join(numbered, "\n")
    first = F.regexp_count(note, F.lit(r"""(?i)["']?point_index["']?\s*:"""))
    return d.select("doc_id", F.when(first == 0, F.regexp_count(note, F.lit(r"(?im)^\s*Point\s+[0-9]+\s*:"))).otherwise(first).cast("long").alias("points"))


def homography_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two numbers of each vector as image points on a court seen in perspective."""
    h = geometry.solve_homography([(250, 850), (1050, 850), (900, 320), (400, 320)], [(0, 0), (10.97, 0), (10.97, 23.77), (0, 23.77)])
    x = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 400 + 650).alias("x"), (F.col("embedding")[1].cast("double") * 200 + 600).alias("y"))
    px, py = geometry.project(h, F.col("x"), F.col("y"))
    return x.select("vec_id", F.round(px, 6).alias("court_x"), F.round(py, 6).alias("court_y"))


def joint_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(6)]
    angle = geometry.joint_angle(*e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(angle, 6).alias("angle"), (angle <= 150).alias("bent"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points of each vector: area, convexity, angle of the first side and where the sides' lines cross."""
    e = [F.col("embedding")[i].cast("double") for i in range(8)]
    points = [(e[i], e[i + 1]) for i in range(0, 8, 2)]
    cx, cy = geometry.line_crossing(e[:4], e[4:])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(geometry.quad_area(points), 6).alias("area"), geometry.convex(points).alias("convex"), F.round(geometry.folded_angle(e[2] - e[0], e[3] - e[1]), 6).alias("angle"), F.round(cx, 3).alias("cross_x"), F.round(cy, 3).alias("cross_y"))


def region_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label with ten vectors or more, the region that holds their middle nine tenths, with a margin."""
    x = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    out = x.groupBy("label").agg(F.count("*").alias("n"), (p("x", 0.05) - 0.05).alias("x_lo"), (p("x", 0.95) + 0.05).alias("x_hi"), (p("y", 0.05) - 0.05).alias("y_lo"), (p("y", 0.95) + 0.05).alias("y_hi"))
    return out.filter("n >= 10")


def _predicted(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    own = islands.sessions(events(spark, sf_dir).filter("event_type in ('click', 'view')"), ["side"], "t", gap, "event_id", bucket=F.floor(F.col("t") / (24 * HOUR)))
    return own.filter("end > start").select("side", F.col("session").alias("id"), "start", "end")


def interval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions at one gap matched one to one with sessions at another, scored by side."""
    predicted, gold = _predicted(spark, sf_dir, 30 * MINUTE), _predicted(spark, sf_dir, 45 * MINUTE)
    pairs = evaluation.matched(predicted, gold, ["side"], 0.3, 4 * HOUR)
    count = lambda df, name: df.groupBy("side").agg(F.count("*").alias(name))
    out = count(predicted, "n_pred").join(count(gold, "n_gold"), "side", "full").join(pairs.groupBy("side").agg(F.count("*").alias("n_match"), F.avg("iou").alias("mean_iou")), "side", "left").fillna(0, ["n_pred", "n_gold", "n_match"])
    return out.withColumns(evaluation.scores(F.col("n_match"), F.col("n_pred"), F.col("n_gold")))


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(_predicted(spark, sf_dir, 45 * MINUTE), _predicted(spark, sf_dir, 30 * MINUTE), ["side"], 4 * HOUR)


def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on texts scored against labels by language: predicted bad where symbols abound."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.regexp_count("text", F.lit("[#*$%&|<>]")) > 10).alias("bad"))
    both = d.join(table(spark, sf_dir, "labels"), "doc_id")
    out = both.groupBy("lang").agg(F.count_if(F.col("bad") & (F.col("quality") == 0)).alias("n_match"), F.count_if("bad").alias("n_pred"), F.count_if(F.col("quality") == 0).alias("n_gold"))
    return out.withColumns(evaluation.scores(F.col("n_match"), F.col("n_pred"), F.col("n_gold")))


QUERIES = {f.__name__: f for f in (frame_profile, state_histogram, format_inference, dominant_end, appearance_centroid, cosine_nearest, identity_assignment, inspection_rows, public_roster, anchor_rows, annotation_counts, homography_projection, joint_angles, quads, region_percentiles, interval_eval, interval_coverage, label_eval)}

_H = geometry.solve_homography([(250, 850), (1050, 850), (900, 320), (400, 320)], [(0, 0), (10.97, 0), (10.97, 23.77), (0, 23.77)])
_V = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(8))
_CENTRES = """WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
 m AS (SELECT label, i::INT AS i, median(x) AS m FROM f GROUP BY 1, 2), c AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m)"""
_PRF = """CASE WHEN n_pred > 0 THEN n_match / n_pred WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN n_gold > 0 THEN n_match / n_gold ELSE 1.0 END::DOUBLE AS recall"""
_COVER = """{n}_new AS (SELECT *, coalesce(("start" > max("end") OVER (PARTITION BY side ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS fresh FROM {n}),
{n}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY side ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM {n}_new),
{n}_len AS (SELECT side, sum(l)::BIGINT AS l FROM (SELECT side, max("end") - min("start") AS l FROM {n}_run GROUP BY side, island) GROUP BY side)"""
_K = "event_type IN ('click', 'view')"

SQL = {
    "anchor_rows": """WITH seen AS (SELECT vec_id // 80 AS match_id, (vec_id % 20) * 500 AS ms, vec_id % 80 // 4 AS track, abs(embedding[1]::DOUBLE) AS area, embedding[2]::DOUBLE AS court_x,
   CASE WHEN (vec_id % 80 // 4 % 2 = 0) <> (label = 0 AND vec_id % 4 = 0) THEN 'near' ELSE 'far' END AS "end", CASE WHEN vec_id // 80 % 2 = 0 THEN 1 ELSE 2 END AS need FROM embeddings),
 prof AS (SELECT match_id, track, count(*) FILTER ("end" = 'near') AS n_near, count(*) AS n FROM seen GROUP BY ALL),
 steady AS (SELECT s.* FROM seen s JOIN prof p USING (match_id, track) WHERE s."end" = CASE WHEN 2 * n_near >= n THEN 'near' ELSE 'far' END AND greatest(n_near, n - n_near) / n >= 0.8),
 large AS (SELECT * FROM steady QUALIFY row_number() OVER (PARTITION BY match_id, ms, "end" ORDER BY area DESC, track) <= need),
 full_frames AS (SELECT match_id, ms, sum(area) AS total FROM large GROUP BY match_id, ms HAVING count(*) = 2 * any_value(need)),
 best AS (SELECT * FROM full_frames QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY total DESC, ms) = 1),
 often AS (SELECT match_id, track, "end", any_value(need) AS need, count(*) AS n, max(area) AS area, arg_max(court_x, area) AS court_x FROM steady WHERE match_id NOT IN (SELECT match_id FROM best) GROUP BY match_id, track, "end"),
 strong AS (SELECT * FROM often QUALIFY row_number() OVER (PARTITION BY match_id, "end" ORDER BY n DESC, area DESC, track DESC) <= need),
 chosen AS (SELECT l.match_id, l.track, l."end", l.court_x FROM large l JOIN best USING (match_id, ms)
  UNION ALL SELECT match_id, track, "end", court_x FROM strong WHERE match_id IN (SELECT match_id FROM strong GROUP BY match_id HAVING count(*) = 2 * any_value(need)))
 SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY "end" <> 'near', court_x, track) - 1 AS slot, track, "end" FROM chosen""",
    "frame_profile": f"""WITH {E}, f AS (SELECT *, t // {6 * HOUR} AS frame FROM e), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame, user_id ORDER BY t DESC, event_id DESC) = 1),
 g AS (SELECT frame, count(*) AS users, count(*) FILTER (event_type = 'view') AS ready, max(value) AS top, median(value) AS median, quantile_cont(value, 0.75) AS q75, list_sort(list(DISTINCT side)) AS sides FROM l GROUP BY frame),
 grid AS (SELECT unnest(range((SELECT min(frame) FROM g), (SELECT max(frame) FROM g) + 1)) AS frame)
 SELECT grid.frame, coalesce(users, 0) AS users, coalesce(ready, 0) AS ready, top, median, q75, sides, CASE WHEN users > 0 THEN ready / users ELSE 0 END::DOUBLE AS ready_share FROM grid LEFT JOIN g ON grid.frame = g.frame""",
    "state_histogram": "SELECT user_id % 2 AS side, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "click", "view", "refund")) + " FROM events GROUP BY 1",
    "format_inference": f"""WITH {E}, h AS (SELECT t // {24 * HOUR} AS day, t // {HOUR} AS hour, count(DISTINCT CASE WHEN side = 0 THEN user_id END) AS near, count(DISTINCT CASE WHEN side = 1 THEN user_id END) AS far FROM e GROUP BY 1, 2),
 d AS (SELECT day, count(*) AS hours, count(*) FILTER (near >= 1 AND far >= 1) AS "both", count(*) FILTER (near >= 2 AND far >= 2) AS pairs FROM h GROUP BY day)
 SELECT *, CASE WHEN "both" = 0 THEN 'unknown' WHEN pairs / greatest("both", 1) >= 0.25 THEN 'doubles' ELSE 'singles' END AS format, least(greatest(abs(pairs / greatest("both", 1) - 0.25::DOUBLE) * 4, 0), 1)::DOUBLE AS confidence FROM d""",
    "dominant_end": """WITH c AS (SELECT n_regionkey, count(*) AS n, sum(c_custkey % 2)::BIGINT AS ones FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
 SELECT n_regionkey, n, CASE WHEN n - ones >= ones THEN 0 ELSE 1 END AS side, greatest(n - ones, ones) / n AS purity FROM c""",
    "appearance_centroid": f"{_CENTRES} SELECT label, i, x FROM c",
    "cosine_nearest": f"""{_CENTRES}, v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, unnest(range(len(embedding)))::INT AS i FROM embeddings),
 p AS (SELECT vec_id, label, sum(x * y) / sqrt(sum(y * y)) / sqrt(sum(x * x)) AS cos FROM v JOIN c USING (i) GROUP BY 1, 2)
 SELECT vec_id, arg_min(label, (round(1 - least(greatest(cos, -1), 1), 9), label)) AS label, min(round(1 - least(greatest(cos, -1), 1), 9)) AS distance FROM p GROUP BY vec_id""",
    "annotation_counts": r"""WITH n AS (SELECT doc_id, list_aggregate(list_transform(string_split(text, '. '), lambda s, i: CASE WHEN lang = 'en' THEN '"point_index": ' ELSE '  point ' END || (i - 1)::VARCHAR || ': ' || s), 'string_agg', chr(10)) AS note FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, len(regexp_extract_all(note, '(?i)["'']?point_index["'']?\s*:')) AS a, len(regexp_extract_all(note, '(?im)^\s*Point\s+[0-9]+\s*:')) AS b FROM n)
 SELECT doc_id, CASE WHEN a = 0 THEN b ELSE a END::BIGINT AS points FROM c""",
    "homography_projection": f"""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 400 + 650 AS x, embedding[2]::DOUBLE * 200 + 600 AS y FROM embeddings)
 SELECT vec_id, round(({_H[0]!r} * x + {_H[1]!r} * y + {_H[2]!r}) / ({_H[6]!r}::DOUBLE * x + {_H[7]!r}::DOUBLE * y + {_H[8]!r}), 6)::DOUBLE AS court_x, round(({_H[3]!r}::DOUBLE * x + {_H[4]!r}::DOUBLE * y + {_H[5]!r}) / ({_H[6]!r}::DOUBLE * x + {_H[7]!r}::DOUBLE * y + {_H[8]!r}), 6)::DOUBLE AS court_y FROM p""",
    "joint_angles": f"""WITH v AS (SELECT vec_id, {_V} FROM embeddings), a AS (SELECT vec_id, degrees(acos(least(greatest(((e0 - e2) * (e4 - e2) + (e1 - e3) * (e5 - e3)) / (sqrt((e0 - e2) ** 2 + (e1 - e3) ** 2) * sqrt((e4 - e2) ** 2 + (e5 - e3) ** 2)), -1), 1))) AS g FROM v)
 SELECT vec_id, round(g, 6) AS angle, g <= 150 AS bent FROM a""",
    "quads": f"""WITH v AS (SELECT vec_id, {_V} FROM embeddings),
 t AS (SELECT *, (e2 - e0) * (e5 - e3) - (e3 - e1) * (e4 - e2) AS t1, (e4 - e2) * (e7 - e5) - (e5 - e3) * (e6 - e4) AS t2, (e6 - e4) * (e1 - e7) - (e7 - e5) * (e0 - e6) AS t3, (e0 - e6) * (e3 - e1) - (e1 - e7) * (e2 - e0) AS t4,
  (e2 - e0) * (e7 - e5) - (e3 - e1) * (e6 - e4) AS d, degrees(atan2(e3 - e1, e2 - e0)) AS g FROM v)
 SELECT vec_id, round((e0 * e3 - e2 * e1 + e2 * e5 - e4 * e3 + e4 * e7 - e6 * e5 + e6 * e1 - e0 * e7) / 2, 6) AS area, least(t1, t2, t3, t4) > 0 OR greatest(t1, t2, t3, t4) < 0 AS convex,
 round(least(abs(g), 180 - abs(g)), 6) AS angle, CASE WHEN abs(d) >= 1e-9 THEN round(e0 + ((e4 - e0) * (e7 - e5) - (e5 - e1) * (e6 - e4)) / d * (e2 - e0), 3) END AS cross_x,
 CASE WHEN abs(d) >= 1e-9 THEN round(e1 + ((e4 - e0) * (e7 - e5) - (e5 - e1) * (e6 - e4)) / d * (e3 - e1), 3) END AS cross_y FROM t""",
    "region_percentiles": """SELECT label, count(*) AS n, quantile_cont(embedding[1]::DOUBLE, 0.05) - 0.05 AS x_lo, quantile_cont(embedding[1]::DOUBLE, 0.95) + 0.05 AS x_hi,
 quantile_cont(embedding[2]::DOUBLE, 0.05) - 0.05 AS y_lo, quantile_cont(embedding[2]::DOUBLE, 0.95) + 0.05 AS y_hi FROM embeddings GROUP BY label HAVING count(*) >= 10""",
    "interval_coverage": f"""WITH {E}, {sessions_sql("side", 45 * MINUTE, _K, "x")}, {sessions_sql("side", 30 * MINUTE, _K, "y")},
 p AS (SELECT side, "start", "end" FROM x WHERE "end" > "start"), g AS (SELECT side, "start", "end" FROM y WHERE "end" > "start"),
 i AS (SELECT p.side, greatest(p."start", g."start") AS "start", least(p."end", g."end") AS "end" FROM p JOIN g ON p.side = g.side AND p."start" < g."end" AND g."start" < p."end"),
 {_COVER.format(n="p")}, {_COVER.format(n="g")}, {_COVER.format(n="i")}
 SELECT side, p_len.l AS kept, g_len.l AS gold, i_len.l AS "both", greatest(p_len.l - i_len.l, 0) AS dead FROM p_len JOIN g_len USING (side) JOIN i_len USING (side)""",
    "label_eval": f"""WITH d AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[#*$%&|<>]')) > 10 AS bad FROM documents),
 c AS (SELECT lang, count(*) FILTER (bad AND quality = 0) AS n_match, count(*) FILTER (bad) AS n_pred, count(*) FILTER (quality = 0) AS n_gold FROM d JOIN labels USING (doc_id) GROUP BY lang),
 s AS (SELECT *, {_PRF} FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s""",
}
