"""Readers and writers of interval and rate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = "array<array<double>>"
_ROWS = "array<struct<start:double,end:double>>"


def read_intervals(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, start, end of JSON files, one document each, in any of three shapes: {"segments": [{"start", "end"}]},
    a list of such rows, or a list of pairs. Rows come sorted by file and start.

    An interval must be finite with 0 <= start < end; others raise if strict, and are left out if not. Files
    that are not such documents have no rows, or raise if strict.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    listed = F.coalesce(F.get_json_object("value", "$.segments"), F.col("value"))
    rows = F.from_json(listed, _ROWS)
    pairs = F.transform(F.from_json(listed, _PAIR), lambda p: F.struct(F.get(p, 0).alias("start"), F.get(p, 1).alias("end")))
    is_rows = listed.rlike(r"^\[\s*(\{|\])")
    found = raw.withColumn("_all", F.when(is_rows, rows).otherwise(pairs))
    if strict:
        found = found.withColumn("_all", F.when(F.col("_all").isNotNull(), F.col("_all")).otherwise(F.raise_error(F.concat(F.lit("no intervals in "), F.col("file"))).cast(_ROWS)))
    out = found.select("file", F.explode("_all").alias("_s")).select("file", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    good = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") < float("inf")), F.lit(False))
    if strict:
        out = out.withColumn("start", F.when(good, F.col("start")).otherwise(F.raise_error(F.lit("an interval needs 0 <= start < end")).cast("double")))
    else:
        out = out.filter(good)
    return out.orderBy("file", "start", "end")


def write_sidecar(points: DataFrame, path: str, key: str) -> None:
    """One JSON document a key: its intervals in order with index, times and lengths rounded to milliseconds."""
    r = lambda c: F.round(c, 3)
    row = F.struct(r(F.col("start")).alias("start"), r(F.col("end")).alias("end"), r(F.col("end") - F.col("start")).alias("duration"))
    whole = points.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("s"))
    whole.select(key, F.transform("s", lambda x, i: F.struct((i + 1).alias("index"), x["start"].alias("start"), x["end"].alias("end"), x["duration"].alias("duration"))).alias("segments"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["duration"]), 3).alias("kept")).write.mode("overwrite").json(path)


def rate(text: Column) -> Column:
    """`num/den` as a number; 0 where it is malformed or den is 0."""
    parts = F.split(text, "/")
    num, den = F.try_to_number(F.get(parts, 0), F.lit("999999999999")), F.try_to_number(F.get(parts, 1), F.lit("999999999999"))
    return F.coalesce(F.try_divide(num.cast("double"), F.coalesce(den, F.lit(0) + F.when(F.size(parts) == 1, 1).otherwise(0)).cast("double")), F.lit(0.0))


def media_info(probes: DataFrame) -> DataFrame:
    """path, duration_s, fps, width, height, has_audio of ffprobe documents (columns path, json): the first video
    stream counts; a duration of 0 falls back to that of the stream."""
    shape = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string>>>"
    rows = probes.select("path", F.from_json("json", shape).alias("d"))
    video = F.get(F.filter("d.streams", lambda s: s["codec_type"] == "video"), 0)
    number = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    fps = F.coalesce(F.nullif(rate(video["avg_frame_rate"]), F.lit(0.0)), rate(video["r_frame_rate"]), F.lit(0.0))
    return rows.select("path", F.coalesce(number(F.col("d.format.duration")), number(video["duration"]), F.lit(0.0)).alias("duration_s"), fps.alias("fps"), video["width"].alias("width"), video["height"].alias("height"), F.coalesce(F.exists("d.streams", lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"))


def points_of(text: Column) -> Column:
    """`x,y;x,y;...` as an array of structs x, y."""
    return F.transform(F.split(text, ";"), lambda p: F.struct(F.get(F.split(p, ","), 0).try_cast("double").alias("x"), F.get(F.split(p, ","), 1).try_cast("double").alias("y")))


def time_grid(df: DataFrame, duration: str, fps: float) -> DataFrame:
    """df with a row for each sample time k / fps below the duration."""
    n = F.ceil(F.col(duration) * fps).cast("long")
    return df.withColumn("_k", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")))).withColumn("time_s", F.col("_k") / fps).drop("_k")


def datasets(files: DataFrame) -> DataFrame:
    """Pairs of files input_<id>.* and res_<id>.txt (column path), inner by id; ids with two inputs are left out."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    inputs = files.select(F.regexp_extract(name, r"^input_(.+)\.[^.]+$", 1).alias("id"), F.col("path").alias("input")).filter("id != ''")
    inputs = inputs.groupBy("id").agg(F.min("input").alias("input"), F.count("*").alias("n")).filter("n = 1").drop("n")
    notes = files.select(F.regexp_extract(name, r"^res_(.+)\.txt$", 1).alias("id"), F.col("path").alias("notes")).filter("id != ''")
    return inputs.join(notes, "id")


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """path and corners (array of x, y) of calibration files: {"court_corners": [[x, y], ...]}. A file of another shape has null corners."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "court_corners array<array<double>>").alias("d"))
    pairs = F.transform("d.court_corners", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return texts.select("path", F.when(F.forall("d.court_corners", lambda p: F.size(p) == 2), pairs).alias("corners"))


def write_calibrations(df: DataFrame, path: str) -> None:
    """One JSON line per row of df (name, corners), in files by name below path."""
    corners = F.transform("corners", lambda p: F.array(p["x"], p["y"]))
    df.select("name", F.to_json(F.struct(corners.alias("court_corners"))).alias("value")).repartition("name").write.partitionBy("name").text(path)
