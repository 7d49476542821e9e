"""Tasks for annotators: at which times to look, and which crops of players to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.court import crop, suggested_slot


def frame_times(matches: DataFrame, segments: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, no (from 0, in order of time) and time_s: n times to look at each match.

    matches: keys, duration; segments: keys, start, end. With n segments or more, the middles of n of them at even steps (ranks rounded half to even); with
    fewer, all middles, and then one segment after the other at 0.3 s, 0.8 s, ... into it, wrapped at its length (0.3 s at least) and at the latest 0.1 s before its end;
    without any, even parts of a duration above 0. Segments without a start or end do not count.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    own = segments.filter("start is not null and end is not null").withColumn("_place", F.row_number().over(w).cast("long") - 1)
    counts = own.groupBy(*keys).agg(F.count("*").alias("_k"))
    rows = matches.join(counts, keys, "left").withColumn("_k", F.coalesce("_k", F.lit(0))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    extra = F.col("_i") - F.col("_k")
    step = F.bround(F.col("_i") * (F.col("_k") - 1) / max(n - 1, 1)).cast("long") if n > 1 else F.lit(0).cast("long")
    rows = rows.withColumn("_place", F.when(F.col("_k") >= n, step).when(F.col("_i") < F.col("_k"), F.col("_i")).when(F.col("_k") > 0, extra % F.col("_k")))
    rows = rows.join(own.select(*keys, "_place", "start", "end"), [*keys, "_place"], "left")
    into = (0.3 + 0.5 * F.floor(extra / F.col("_k"))) % F.greatest(F.col("end") - F.col("start"), F.lit(0.3))
    late = F.least(F.col("end") - 0.1, F.col("start") + into)
    even = F.when(F.col("duration") > 0, F.col("duration") * (F.col("_i") + 1) / (n + 1))
    time = F.when(F.col("_k") == 0, even).when((F.col("_k") >= n) | (F.col("_i") < F.col("_k")), (F.col("start") + F.col("end")) / 2).otherwise(late)
    rows = rows.withColumn("time_s", time).filter("time_s is not null")
    order = Window.partitionBy(*keys).orderBy("time_s", "_i")
    return rows.select(*keys, (F.row_number().over(order) - 1).alias("no"), "time_s")


def player_crops(boxes: DataFrame, regions: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, task, time_s, crop and suggested: of each match, `most` crops at most, frame by frame, in a frame the largest box first.

    boxes: keys, time_s, x0, y0, x1, y1 (pixels), width, height; regions: keys, left, top, right, low (shares of the frame; a match without one takes every box) and
    doubles. Only boxes whose foot is in the region count, borders included, and whose crop is large enough. Equal areas go by the box, greatest first.
    """
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    width, height = F.col("width"), F.col("height")
    rows = boxes.join(regions, keys, "left").withColumns({"_fx": (box[0] + box[2]) / 2 / width, "_fy": box[3] / height, "crop": crop(box, width, height)})
    inside = F.col("left").isNull() | (F.col("_fx").between(F.col("left"), F.col("right")) & F.col("_fy").between(F.col("top"), F.col("low")))
    rows = rows.filter(inside & F.col("crop").isNotNull())
    area = (box[2] - box[0]) * (box[3] - box[1])
    order = Window.partitionBy(*keys).orderBy("time_s", area.desc(), *(c.desc() for c in box))
    rows = rows.withColumn("task", F.row_number().over(order) - 1).filter(F.col("task") < most)
    slot = suggested_slot(F.col("_fx"), F.col("_fy"), (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("low")) / 2, F.coalesce("doubles", F.lit(False)))
    return rows.select(*keys, "task", "time_s", "crop", slot.alias("suggested"))


# The words that a label of each kind may use. Fields of ROSTER take the ids of the job's roster as well.
WORDS = {
    ("player_identity", "quality"): ("clear", "partial", "occluded", "not_player"),
    ("serve_motion", "is_serve"): ("yes", "no", "unsure"),
    ("serve_motion", "server"): ("unknown",),
    ("serve_motion", "side"): ("deuce", "ad"),
    ("serve_motion", "end"): ("near", "far"),
    ("serve_motion", "serve_type"): ("flat", "slice", "kick"),
    ("serve_motion", "outcome"): ("in", "fault", "ace", "let"),
}
ROSTER = (("player_identity", "player"), ("serve_motion", "server"))
NOTES, LONGEST_NOTE = ("serve_motion", "notes"), 1000


def checked_labels(values: DataFrame, roster: DataFrame) -> DataFrame:
    """values (job, task, kind, field, value) with clean, what is stored, and error: unknown_field, unknown_value or long_note. Null and empty values are
    stored as nothing and are no error, but for a field that no label of the kind has. roster: job, id. Notes lose the white space around them."""
    spark = values.sparkSession
    words = spark.createDataFrame([(*f, w) for f, ws in WORDS.items() for w in ws], "kind string, field string, value string")
    fields = spark.createDataFrame(sorted({*WORDS, *ROSTER, NOTES}), "kind string, field string").withColumn("_field", F.lit(True))
    ids = spark.createDataFrame(list(ROSTER), "kind string, field string")
    rows = values.join(F.broadcast(fields), ["kind", "field"], "left").join(F.broadcast(words.withColumn("_word", F.lit(True))), ["kind", "field", "value"], "left")  # fixed tables
    named = roster.select("job", F.col("id").alias("value")).distinct().crossJoin(F.broadcast(ids)).withColumn("_id", F.lit(True))  # two rows an id
    rows = rows.join(named, ["job", "kind", "field", "value"], "left")
    note = (F.col("kind") == NOTES[0]) & (F.col("field") == NOTES[1])
    blank = F.coalesce(F.col("value") == "", F.lit(True))
    short = F.regexp_replace("value", r"^\s+|\s+$", "")
    error = F.when(F.col("_field").isNull(), "unknown_field").when(blank, F.lit(None)).when(note, F.when(F.length(short) > LONGEST_NOTE, "long_note")).when(F.coalesce("_word", "_id").isNull(), "unknown_value")
    clean = F.when(error.isNull() & ~blank, F.when(note, short).otherwise(F.col("value")))
    return rows.select("job", "task", "kind", "field", "value", clean.alias("clean"), error.alias("error"))


def exported(jobs: DataFrame, roster: DataFrame, tasks: DataFrame, labels: DataFrame) -> DataFrame:
    """job and document: for each job with a feature context (jobs: job, filename, context), one JSON text of its roster (job, id, name), tasks (job, task, kind, time_s) and
    clean labels (job, task, field, clean), each list in order. Jobs without a context cannot be exported and have no row."""
    lists = lambda df, name, *fields: df.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    rows = jobs.filter("context is not null").join(lists(roster, "roster", "id", "name"), "job", "left").join(lists(tasks, "tasks", "task", "kind", "time_s"), "job", "left")
    rows = rows.join(lists(labels.filter("clean is not null"), "labels", "task", "field", "clean"), "job", "left")
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), rows.schema[c].dataType)).alias(c)
    return rows.select("job", F.to_json(F.struct("job", "filename", empty("roster"), empty("tasks"), empty("labels"), F.col("context").alias("feature_context"))).alias("document"))
