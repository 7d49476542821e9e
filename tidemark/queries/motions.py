"""Serves and strokes over poses made up from events: one actor a user, six rows a second, moving as its values say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import roster
from tidemark.operators.ranges import by_key
from tidemark.plans import decode, live, motions, service
from tidemark.queries.base import events, table
from tidemark.sources.scratch import written


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("double")
    v = F.least(F.col("value") / 100, F.lit(1.0))
    e = events(spark, sf_dir).withColumn("n", n)
    wave = lambda pace, phase: F.sin(F.col("n") * pace + phase) * (0.4 + v)
    rows = e.select(
        F.floor(F.col("user_id") / 4).alias("match"), F.col("user_id").alias("actor_id"), (F.col("n") * 166).cast("long").alias("ms"),
        (3 + F.sin(F.col("n") / 50)).alias("court_x"), F.when(F.col("side") == 0, 1.0).otherwise(23.0).alias("court_y"), F.when(F.col("side") == 0, "near").otherwise("far").alias("actor_end"),
        (F.col("event_type") == "view").alias("ready"), (140 + F.pmod(F.col("event_id"), F.lit(40))).cast("double").alias("knee"), (F.col("event_type") == "purchase").alias("associated"), F.lit("right").alias("racket_hand"),
        wave(0.9, 0.0).alias("left_x"), (-wave(0.7, 1.0)).alias("left_y"), wave(0.9, 2.0).alias("right_x"), (-wave(0.7, 0.3)).alias("right_y"),
        (2 * v).alias("left_speed"), (1.5 * v).alias("right_speed"), (100 + F.pmod(F.col("event_id"), F.lit(60))).cast("double").alias("left_elbow"), (110 + F.pmod(F.col("event_id"), F.lit(50))).cast("double").alias("right_elbow"),
    )
    return rows.withColumns({"left_over": -F.col("left_y"), "right_over": -F.col("right_y")}).withColumn("over_ratio", F.greatest("left_over", "right_over"))


def serve_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = _poses(spark, sf_dir)
    opposed = pose.groupBy("match", "ms").agg(F.countDistinct("actor_end").alias("ends")).filter("ends = 2").select("match", "ms")
    return motions.serves(pose, opposed, ["match"])


def stroke_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = _poses(spark, sf_dir)
    return motions.strokes(pose, serve_detection(spark, sf_dir).filter("accepted").select("match", "ms"), ["match"])


def corner_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label, the median of the largest neighbourhood among the first eight numbers of ten vectors each."""
    x = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("scene"), "vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("points"), F.lit(1.0).alias("score"))
    return roster.consensus(x, ["scene"], "vec_id", "points", "score", 0.25)


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = written(_poses(spark, sf_dir))
    keys = ["match"]
    opposed = pose.groupBy("match", "ms").agg(F.countDistinct("actor_end").alias("ends")).filter("ends = 2").select("match", "ms")
    # Poses are dealt before the windows are planned: what these are made of is worked out behind the shuffle and does not pass through it.
    tried = written(motions.serves(pose.repartition(*keys, "actor_id"), opposed, keys))
    end = F.when(F.col("actor_id") % 2 == 0, "near").otherwise("far").alias("end")
    hits = written(motions.strokes(pose, tried.filter("accepted").select("match", "ms"), keys).select("match", F.col("top").alias("ms"), "actor_id", "session", end))
    seconds = lambda c: (F.col(c) / 1000).cast("double")
    strokes = hits.select("match", F.struct("actor_id", "session").alias("stroke_id"), seconds("ms").alias("t"), "end")
    serves = tried.select("match", "actor_id", "ms", F.struct("ms", "actor_id", "hand").alias("serve_id"), seconds("ms").alias("strike"), seconds("setup_ms").alias("setup"), end, "half", F.lit(None).cast("string").alias("team"), "score", F.lit(True).alias("evidence"), "accepted")
    serves = written(decode.promoted(serves, strokes, keys).filter("accepted"))
    players = pose.select("match", "ms", "actor_id", F.col("actor_end").alias("end"), "ready", F.greatest("left_speed", "right_speed").alias("wrist_speed"), F.col("left_speed").alias("court_speed"))
    seen = written(live.frames(players, keys))
    events = live.answers(live.numbered(serves, hits, keys), seen, keys)
    bouts = live.bouts(live.windows(seen, events, keys), keys)
    hyp = service.point_hypotheses(serves, strokes, bouts, keys, float(1 << 20))
    ends = pose.groupBy("match").agg((F.max("ms") / 1000 + 1).alias("duration"))
    return decode.decoded(hyp.join(by_key(ends), "match"), strokes, keys, F.col("duration"))[0]


def point_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From poses to points: serves, strokes, per-end windows, bouts, hypotheses, strokes in turn, and where each point ends and why."""
    return _decoded(spark, sf_dir).drop("serve_id", "duration")


QUERIES = {f.__name__: f for f in (serve_detection, stroke_episodes, corner_consensus, point_decoding)}
SQL: dict[str, str] = {}
