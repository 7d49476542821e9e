"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a 60-bit hash. Tokens are summed by source and hash bucket, the bucket in which a
source's budget is used up is found by a running sum over at most 4096 buckets, and only that bucket is
refined with the next 12 bits until the threshold is exact. A filter on hash < threshold then takes the
documents: no sort of documents, and a smaller budget always takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, word_count

BITS, LEVEL = 60, 12
#: The per-source tables are broadcast up to so many sources (under 10 MB); beyond, Spark picks the join.
BROADCAST_SOURCES = 100_000
#: Fixed values of the production mix: weights by rank of source, and the most a source is repeated.
WEIGHTS, MOST = (1, 2, 3), 3


def hash60(*parts: Column) -> Column:
    """The first 60 bits of an md5 over the parts, null as empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with _source, _size (words of the whole text) and _u, the hash of id and text."""
    text = F.col("text").cast("string")
    return docs.select(*keep, F.col("source").alias("_source"), word_count(text).alias("_size"), hash60(F.col("doc_id"), text).alias("_u"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: _source, _all (its size) and _target. Sources in code-point order, null last, weigh
    `weights` in turn and share the size of all; a target stops at most times its source's size and the
    excess goes to the others by weight. One row a source passes through one task."""
    own = rows.groupBy("_source").agg(F.sum("_size").alias("_all"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    level = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("_w", level.cast("double")).withColumn("_cap", (F.col("_all") * most).cast("double"))
    # Sources reach their cap in the order of cap by weight; the first that does not sets the level of all after it.
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("_lam", (F.sum("_all").over(everything).cast("double") - before) / rest)
    first = F.min(F.when(F.col("_lam") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source", "_lam")))
    own = own.withColumn("_lam", first.over(everything)["_lam"])
    return own.select("_source", "_all", F.least("_cap", F.col("_lam") * F.col("_w")).alias("_target"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """Per source: _source, _all, _target, _copies (whole copies of each document) and _cut (documents with
    _u below it are taken once more); and the number of sources.

    The document at the threshold is taken if that brings the source nearer to its target. Rows with the
    same id and text have one hash and are taken or left together.
    """
    goal = targets(rows, weights, most)
    copies = F.when(F.col("_all") > 0, F.floor(F.col("_target") / F.col("_all"))).otherwise(0).cast("long")
    goal = save(goal.withColumn("_copies", copies).withColumn("_left", F.col("_target") - F.col("_copies") * F.col("_all")))
    n = goal.count()
    state = goal.select(F.col("_source").alias("_s"), "_left", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
    part = rows
    for done in range(0, BITS, LEVEL):
        shift = BITS - done - LEVEL
        inside = part.join(small(state, n), F.col("_source").eqNullSafe(F.col("_s")) & (F.shiftright("_u", shift + LEVEL) == F.col("_prefix")))
        if done == LEVEL:
            inside = part = save(inside.select("_source", "_size", "_u", "_s", "_left", "_prefix", "_below"))
            part = part.select("_source", "_size", "_u")
        sums = inside.groupBy("_s", "_left", "_below", F.shiftright("_u", shift).alias("_prefix")).agg(F.sum("_size").alias("_n"))
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy("_s").orderBy("_prefix"))
        over = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_left"))
        edge = over.groupBy("_s", "_left").agg(F.min(F.struct("_prefix", "_upto", "_n")).alias("_e"))
        edge = edge.select("_s", "_left", F.col("_e._prefix").alias("_prefix"), (F.col("_e._upto") - F.col("_e._n")).alias("_below"), F.col("_e._upto").alias("_upto"))
        edge = save(edge)
        state = edge.drop("_upto")
    nearer = (F.col("_upto") - F.col("_left") < F.col("_left") - F.col("_below")).cast("long")
    cut = edge.select("_s", (F.col("_prefix") + nearer).alias("_c"))
    out = goal.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return save(out.select("_source", "_all", "_target", "_copies", F.coalesce("_c", F.lit(1 << BITS)).alias("_cut"))), n


def times() -> Column:
    """How often a measured and planned row is taken."""
    return F.col("_copies") + (F.col("_u") < F.col("_cut")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken (words taken, repeats counted).

    Null and empty texts have size 0 and take nothing. A null source is a source of its own. Repeated
    rows each count. An empty table gives an empty table; extra columns are left out. A source of a few
    very long documents comes as near to its target as its documents allow.
    """
    rows = save(measured(docs, ["doc_id"]))
    goal, n = plan(rows, weights, most)
    goal = goal.withColumnRenamed("_source", "_s")
    joined = rows.join(small(goal, n), F.col("_source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * times()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    keep = docs.columns
    goal, n = plan(save(measured(docs, [])), weights, most)
    goal = goal.withColumnRenamed("_source", "_s")
    # The text is measured in place again, so no join by document is needed.
    text = docs["text"].cast("string")
    rows = docs.withColumn("_u", hash60(docs["doc_id"], text))
    taken = rows.join(small(goal, n), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_times", times().cast("int"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_times")))
    return taken.filter("_times > 0").select(*(F.col(f"`{c}`") for c in keep), copies.alias("_copy")).drop("_copy")
