"""Tables published as versions: each attempt writes a folder of its own, and a version is a small file that only one attempt can create.

    root/attempts/<name>/<table>/...    what an attempt wrote; seen by nobody until it is published
    root/versions/000000000007          names the attempt that version 7 is

A writer says which version it began from. It publishes by creating the next version's file, which the file system refuses where the
file is there already: of two writers that began from one version, one wins and the other is told that it is stale, however their steps
interleave. Versions never change, so a reader that has resolved one reads whole tables of one attempt, also while the next is written.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.islands import coalesce_intervals


class Stale(RuntimeError):
    """Another attempt published first."""


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def prepare(root: str, tables: dict[str, DataFrame]) -> str:
    """Write the tables as an attempt, and return its name. Nothing is published; a failed or abandoned attempt is a folder that nobody reads."""
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{root}/attempts/{name}/{table}")
    return name


def publish(spark: SparkSession, root: str, attempt: str, parent: int) -> int:
    """Make the attempt the version after parent (0: the first one), or raise Stale if that version is taken. Publishing again what is
    published already gives its number again, so a retried step does no harm."""
    version = parent + 1
    fs, at = _path(spark, f"{root}/versions/{version:012d}")
    try:
        if fs.getUri().getScheme() == "file":
            _create_local(at.toUri().getPath(), attempt)
        else:
            out = fs.create(at, False)
            out.write(attempt.encode())
            out.close()
    except Exception as e:
        if not fs.exists(at):
            raise
        if resolve(spark, root, version) == attempt:
            return version
        raise Stale(f"version {version} of {root} is taken") from e
    return version


def _create_local(path: str, attempt: str) -> None:
    """Create the file with its content, or raise FileExistsError. Hadoop's local file system looks whether a file is there and then creates
    it, so two writers can both succeed; a link to a whole file is made by one only."""
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "x") as f:
        f.write(attempt)
    try:
        os.link(own, path)
    finally:
        os.unlink(own)


def resolve(spark: SparkSession, root: str, version: int) -> str | None:
    """The attempt that a version names; None if there is no such version, or its name is not written yet."""
    fs, at = _path(spark, f"{root}/versions/{version:012d}")
    if not fs.exists(at):
        return None
    size = fs.getFileStatus(at).getLen()
    if not size:
        return None
    source = fs.open(at)
    try:
        return bytes(source.readNBytes(size)).decode()
    finally:
        source.close()


def latest(spark: SparkSession, root: str) -> int:
    """The newest whole version, 0 if there is none."""
    fs, at = _path(spark, f"{root}/versions")
    if not fs.exists(at):
        return 0
    numbers = sorted((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), reverse=True)
    return next((n for n in numbers if resolve(spark, root, n)), 0)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the newest if None. A version that does not exist is an error."""
    number = latest(spark, root) if version is None else version
    attempt = resolve(spark, root, number)
    if attempt is None:
        raise FileNotFoundError(f"no version {number} of {root}")
    return spark.read.parquet(f"{root}/attempts/{attempt}/{table}")


def edit_segments(spark: SparkSession, root: str, edits: DataFrame, parent: int, least: float = 0.05) -> int:
    """Publish the version after parent in which the matches of edits (match, start, end) have the edited segments: longer than `least`, in order, those that touch
    united, numbered anew. Their points are emptied, as they no longer fit; other matches keep both. Raises Stale if parent is no longer the newest."""
    changed = edits.select("match").distinct()
    clean = coalesce_intervals(edits.filter(F.col("end") - F.col("start") > least).select("match", "start", "end"), ["match"]).select("match", "start", "end")
    kept = read(spark, root, "segments", parent).join(changed, "match", "left_anti").select("match", "start", "end")
    points = read(spark, root, "points", parent).join(changed, "match", "left_anti")
    return publish(spark, root, prepare(root, {"segments": kept.unionByName(clean), "points": points}), parent)
