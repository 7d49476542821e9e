"""Shards of near-equal bytes by a k-d tree over metadata, in DataFrame operations only.

A node that is to give several leaves is cut along its widest metadata dimension at the weighted median (at the weighted
quantile for an odd number of leaves), until each node is one leaf, which holds the target bytes.

Rows are summed into cells first: a cell is one combination of dimension codes, and where that weighs more than
1/FINE of a leaf, an interval of a 62-bit key, cut again and again until it is light. Both sums are distributed hash
aggregates; rows of light cells take no part in later rounds. The number of cells depends on FINE, the leaves and the
combinations of codes, not on the rows, so the tree itself is built on a bounded table, whole cells to a side.
The order along a dimension is (its code, the other codes, key), so a hot source or a group of copies that holds a third of all
bytes is cut inside like any other stretch. Equal texts are neighbours in the key: they lie in one shard unless a cut falls between
them. A row's slot is the number of rows in the cells before its own plus its place in its cell, so no task sees a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save

#: A leaf is put together from about this many cells or more: leaves differ by a few parts of FINE, or by one row.
FINE = 256
#: Intervals that one round cuts a heavy cell into, at most.
MOST_WAYS = 4096
#: Classes of a category.
CLASSES = 1024


def category(c: Column) -> Column:
    """The code of a nominal value: one of CLASSES hash classes, -1 for null."""
    return F.when(c.isNull(), -1).otherwise(F.pmod(F.xxhash64(c), F.lit(CLASSES))).cast("long")


def magnitude(c: Column) -> Column:
    """The code of a size: its quarter octave, -1 for null."""
    return F.coalesce(F.floor(4 * F.log2(F.greatest(c, F.lit(0)) + 1)), F.lit(-1)).cast("long")


def _codes(n: int) -> list[str]:
    return [f"c{d}" for d in range(n)]


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("u").alias("u0"), F.max("u").alias("u1"))


def _refined(rows: DataFrame, heavy: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with the interval of a heavy cell that they fall into; how "left" keeps rows of light cells as they are."""
    cut = heavy.select(*keys, F.col("k0").alias("_k0"), F.col("u0").alias("_u0"), "wide_k", "wide_u")
    into = lambda v, low, wide: F.expr(f"{low} + {wide} * (({v} - {low}) div {wide})")
    found = rows.join(F.broadcast(cut), keys, how)  # at most 2 * leaves * FINE rows, whatever the size of the input
    by_k, by_u = F.col("wide_k").isNotNull(), F.col("wide_u").isNotNull()
    return found.select(*rows.drop("lo", "lo2").columns, F.when(by_k, into("k", "_k0", "wide_k")).otherwise(F.col("lo")).alias("lo"), F.when(by_u, into("u", "_u0", "wide_u")).otherwise(F.col("lo2")).alias("lo2"))


def cells_of(rows: DataFrame, dims: int, leaves: int) -> tuple[DataFrame, list[DataFrame]]:
    """The light cells, c0.., lo, lo2, n, bytes, and the heavy ones of each round. Rows equal in key k are told apart by u."""
    keys = [*_codes(dims), "lo", "lo2"]
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    most_bytes, most_rows = max(1.0, total.bytes / (leaves * FINE)), max(1.0, total.n / (leaves * FINE))
    share = F.greatest(F.col("bytes") / most_bytes, F.col("n") / most_rows)
    ways = F.least(F.lit(MOST_WAYS), F.greatest(F.lit(2), F.ceil(2 * share))).cast("long")
    over = (F.col("n") > 1) & (share > 1)
    left, light, rounds = rows, None, []
    while True:
        found = _cells(left, keys)
        found = found.withColumn("wide_k", F.when(over & (F.col("k0") < F.col("k1")), F.expr("k1 - k0") / ways + 1).cast("long"))
        found = save(found.withColumn("wide_u", F.when(over & F.col("wide_k").isNull() & (F.col("u0") < F.col("u1")), F.expr("u1 - u0") / ways + 1).cast("long")))
        is_heavy = F.col("wide_k").isNotNull() | F.col("wide_u").isNotNull()
        done = found.filter(~is_heavy).select(*keys, "n", "bytes")
        light, heavy = done if light is None else light.unionByName(done), found.filter(is_heavy)
        if heavy.isEmpty():
            return light, rounds
        rounds.append(heavy)
        left = _refined(left, heavy, keys, "inner")


def tree(cells: DataFrame, dims: int, leaves: int) -> DataFrame:
    """cells with leaf, from 0, and wide, the dimension of the last cut that the cell went through.

    Each level cuts every node that is to give more than one leaf: along the dimension whose codes span most in it, measured by the
    span over all cells (the first of equals), with a cell on the side where its middle lies."""
    codes = _codes(dims)
    spans = cells.agg(*(F.greatest(F.max(c) - F.min(c), F.lit(1)).alias(f"all_{c}") for c in codes))
    at = cells.crossJoin(F.broadcast(spans)).withColumn("leaf", F.lit(0)).withColumn("into", F.lit(leaves)).withColumn("wide", F.lit(-1))  # one row
    node = Window.partitionBy("leaf", "into")
    for _ in range((leaves - 1).bit_length()):
        span = [(F.max(c).over(node) - F.min(c).over(node)) / F.col(f"all_{c}") for c in codes]
        at = at.withColumn("_span", F.array(*span)).withColumn("_dim", (F.array_position("_span", F.array_max("_span")) - 1).cast("int"))
        turned = F.array(*codes)
        at = at.withColumn("_order", F.concat(F.array(F.get(turned, F.col("_dim"))), turned))
        upto = F.sum("bytes").over(node.orderBy("_order", "lo", "lo2").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at = at.withColumn("_upto", upto).withColumn("_all", F.sum("bytes").over(node)).withColumn("_first", F.expr("into div 2").cast("int"))
        at = at.withColumn("_low", (F.col("_upto") - F.col("bytes") / 2) * F.col("into") <= F.col("_all") * F.col("_first"))
        cut = F.col("into") > 1
        at = at.select(*cells.columns, *(f"all_{c}" for c in codes),
            F.when(cut & ~F.col("_low"), F.col("leaf") + F.col("_first")).otherwise(F.col("leaf")).alias("leaf"),
            F.when(~cut, F.col("into")).when(F.col("_low"), F.col("_first")).otherwise(F.col("into") - F.col("_first")).alias("into"),
            F.when(cut, F.col("_dim")).otherwise(F.col("wide")).alias("wide"))
    return at.select(*cells.columns, "leaf", "wide")


def split(docs: DataFrame, dims: dict[str, Column], size: Column, id_col: str = "doc_id", text_col: str = "text", leaves: int | None = None, target_bytes: int | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """keep (all columns of docs if None), size, shard (from 0) and slot (gapless from 0 in each shard): one row per row of docs.

    dims: code columns (category, magnitude, or any whole number; null counts as -1). size: the weight of a row, null 0. Give the
    number of leaves, or target_bytes, from which it follows. Shards hold near-equal sums of size; their numbers follow the tree,
    so neighbours are alike in metadata. Null and empty texts are rows like others, a text of any length is one row and is never cut; a
    row heavier than a leaf leaves its neighbours short. Rows equal in id and text are interchangeable, and may be parted. An empty table gives an empty
    table. Columns of docs named size, shard or slot are replaced; no other name can clash. docs is read once.
    """
    if keep is None:
        keep = {c: docs[c] for c in docs.columns if c not in ("size", "shard", "slot")}
    codes = _codes(len(dims))
    near = F.shiftleft(F.xxhash64(text_col).bitwiseAND((1 << 30) - 1), 32)
    rows = docs.select(
        F.struct(*(c.alias(name) for name, c in keep.items())).alias("row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        *(F.coalesce(c, F.lit(-1)).cast("long").alias(name) for name, c in zip(codes, dims.values(), strict=True)),
        near.bitwiseOR(F.xxhash64(id_col).bitwiseAND((1 << 32) - 1)).alias("k"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2).alias("u"),
        F.lit(0).cast("long").alias("lo"),
        F.lit(0).cast("long").alias("lo2"),
    )
    rows = save(rows)
    if leaves is None:
        leaves = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    light = rows.drop("row")
    cells, rounds = cells_of(light, len(dims), leaves)
    keys = [*codes, "lo", "lo2"]
    placed = tree(cells, len(dims), leaves)
    before = F.sum("n").over(Window.partitionBy("leaf").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = save(placed.select(*keys, F.col("leaf").cast("int").alias("shard"), before.alias("_before")))
    for heavy in rounds:
        rows = _refined(rows, heavy, keys, "left")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("k", "u"))
    return rows.join(placed, keys).withColumn("slot", F.col("_before") + place - 1).select("row.*", "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The rows of split(docs, **how) as Parquet, a folder shard=N each, in the order of slots within and across its files."""
    split(docs, **how).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int) -> DataFrame:
    """Per document: its size (UTF-8 bytes and 16), the crc32 of its text, its shard and slot under the law of near-equal bytes."""
    text = F.coalesce("text", F.lit(""))
    dims = {"lang": category(F.col("lang")), "source": category(F.col("source")), "n_chars": magnitude(F.col("n_chars"))}
    keep = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text.cast("binary"))}
    found = split(docs, dims, F.octet_length(text) + 16, leaves=shards, keep=keep)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
