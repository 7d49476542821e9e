"""Helpers shared by the training-data operators: shared scratch tables, word rules, batch slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word rule, and A-Z for lower-casing without a locale.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that a Python task handles at once.
SLICE_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary
    folder serves a local master (tests on one machine); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write df to a scratch table and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete the files of tables that save() returned, once nothing will read them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of the word rule in the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most about so many bytes of the text column (one row at least)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The slices of batch_slices, each with its texts as a list."""
    for part in batch_slices(batches, column):
        yield part, part.column(column).to_pylist()


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on after its task, and would hold what its largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The runs values[start[p] : start[p] + size[p]] of all p of place, one after the other."""
    sizes = size[place]
    shift = np.repeat(start[place] - (np.cumsum(sizes) - sizes), sizes)
    return values[shift + np.arange(len(shift))]
