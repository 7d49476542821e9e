"""Tables of jobs: status from events, versions of edits, public views, queue and timers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much of an error is shown, and what counts as white space at its end.
ERROR_CHARS, TRAILING = 1500, r"[\x20\x09-\x0D]+$"


def last_status(rows: DataFrame, keys: list[str], time: str, tie: str, status: str, ready: Column) -> DataFrame:
    """keys, status, retryable: the last status by time. A cancelled job that completed before is complete again, or
    no_output where that result's output is not `ready` any more; a cancelled or failed job can be tried again."""
    at = F.struct(time, tie)
    done = F.col(status) == "complete"
    out = rows.groupBy(*keys).agg(F.max_by(status, at).alias("last"), F.max_by(F.when(done, F.coalesce(ready, F.lit(False))), F.when(done, at)).alias("ready"))
    shown = F.when((F.col("last") != "cancelled") | F.col("ready").isNull(), F.col("last")).when(F.col("ready"), "complete").otherwise("no_output")
    return out.select(*keys, shown.alias("status"), F.col("last").isin("cancelled", "failed").alias("retryable"))


def edited(segments: DataFrame, edits: DataFrame, keys: list[str], edit_time: str) -> DataFrame:
    """segments with version (1 and one more for each edit), points (none once edited) and actions_stale."""
    count = edits.groupBy(*keys).agg(F.count("*").alias("_edits"), F.max(edit_time).alias("edited_at"))
    out = segments.join(count, keys, "left").withColumn("_edits", F.coalesce("_edits", F.lit(0)))
    return out.withColumns({"version": F.col("_edits") + 1, "points": F.when(F.col("_edits") == 0, F.col("points")).otherwise(0), "actions_stale": F.col("_edits") > 0}).drop("_edits")


def base_name(path: Column) -> Column:
    """The last part of an absolute path; anything else as it is."""
    return F.when(path.startswith("/"), F.regexp_extract(path, r"([^/]*)/*$", 1)).otherwise(path)


def shown_error(error: Column) -> Column:
    """An error of more than ERROR_CHARS characters cut there, without white space at the end, and marked."""
    cut = F.concat(F.regexp_replace(F.substring(error, 1, ERROR_CHARS), TRAILING, ""), F.lit(" ..."))
    return F.when(F.length(error) > ERROR_CHARS, cut).otherwise(error)


def public_view(jobs: DataFrame, status: str, error: str, hidden: list[str]) -> DataFrame:
    """jobs without columns that end in _path, the error cut, and `hidden` columns null while the job waits or runs."""
    busy = F.coalesce(F.col(status).isin("queued", "running"), F.lit(False))
    out = jobs.select(*(F.col(c) for c in jobs.columns if not c.endswith("_path")))
    return out.withColumns({error: shown_error(F.col(error)), **{c: F.when(~busy, F.col(c)) for c in hidden}})


def stage_summary(rows: DataFrame, keys: list[str], stage: str, status: str, order: list[str]) -> DataFrame:
    """keys, position, stage, status: the stages that are present, in a fixed order; a stage without status is recorded."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(stage))
    found = rows.filter(place > 0).groupBy(*keys, place.cast("int").alias("position"), F.col(stage).alias("stage")).agg(F.max(status).alias("status"))
    return found.withColumn("status", F.coalesce("status", F.lit("recorded")))


def occupancy(sets: list[DataFrame], keys: list[str], member: str) -> DataFrame:
    """keys and occupied, the number of members of the union of all sets."""
    union = reduce(DataFrame.unionByName, (s.select(*keys, member) for s in sets))
    return union.groupBy(*keys).agg(F.count_distinct(member).alias("occupied"))


def stale(uploads: DataFrame, used: DataFrame, keys: list[str], time: str, age: float) -> DataFrame:
    """uploads that nothing in `used` refers to and that are more than `age` older than the newest upload."""
    newest = uploads.agg(F.max(time).alias("_newest"))
    rest = uploads.join(used.select(*keys).distinct(), keys, "left_anti").join(F.broadcast(newest))
    return rest.filter(F.col("_newest") - F.col(time) > age).drop("_newest")


def event_timeline(serves: DataFrame, keys: list[str], value: str, scale: int = 1000) -> DataFrame:
    """keys, n, serves: the finite values in order as whole thousandths."""
    v = F.col(value)
    kept = serves.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    w = Window.partitionBy(*keys)
    whole = F.round(v * scale).cast("long")
    return kept.withColumn("_v", whole).withColumn("_n", F.count("*").over(w)).groupBy(*keys).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list("_v")).alias("serves"))


def usage(files: DataFrame, keys: list[str], job: str, size: Column) -> DataFrame:
    """keys, jobs, used: how many jobs have files and how many bytes these take; a file without size takes none."""
    return files.groupBy(*keys).agg(F.count_distinct(job).alias("jobs"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("used"))


def admission(stores: DataFrame, max_jobs: int, max_bytes: int, max_upload: int, max_pending: int) -> DataFrame:
    """stores (with jobs, used, reserved and pending) with verdict, the first limit that is reached or accepted, and
    reservation, the bytes that an accepted upload may take."""
    free = F.lit(max_bytes) - F.col("used") - F.col("reserved")
    verdict = F.when(F.col("jobs") >= max_jobs, "jobs").when(free <= 0, "bytes").when(F.col("pending") >= max_pending, "queue").otherwise("accepted")
    return stores.withColumn("verdict", verdict).withColumn("reservation", F.when(F.col("verdict") == "accepted", F.least(F.lit(max_upload), free)))


def actions(episodes: Column, decisions: Column) -> Column:
    """A job's actions: its episodes; where it has no list of them, for each decision its stroke_episodes or, without
    these, its actions that are no serves. Null elements are left out; a job with neither has none."""
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    rallied = lambda a: F.filter(a, lambda x: x.isNotNull() & ~x["action"].eqNullSafe("serve"))
    of_decision = lambda d: F.coalesce(present(d["stroke_episodes"]), rallied(d["actions"]))
    nested = F.flatten(F.filter(F.transform(present(decisions), of_decision), lambda a: a.isNotNull()))
    return F.coalesce(present(episodes), nested, F.slice(episodes, 1, 0), F.array())
