"""The prefix trie of conversations, from mergeable partial tries.

Each task walks its conversations turn by turn and sums the nodes that it meets in a table of its own: a node is named by a
128-bit hash of its path, and has its members' count and smallest id, and the ids of the conversations that end there. Full tables are sent
on and begun anew, so memory is bounded. Partial tables are merged by node in rounds: rows of one node from FAN tasks become one,
until one is left, so the root and a very common first turn are never more than FAN rows of a task in one task. Lists of ends are
blocks of a range of ids, so that none grows with the input.

Bottom-up sums go along pointers that double: with sums over the descendants nearer than 2^k, each node hands its own
to its ancestor 2^k above, log2(depth) rounds in all. Nodes of one member are chains without branches: they
have one leaf and nothing to save, and take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, word_count

#: Partial tables that one merge makes into one.
FAN = 64
#: Nodes and ends that a task holds before it sends its table on.
MOST_HELD = 200_000
#: Ids to a block of ends, as a power of two.
BLOCK_BITS = 16
#: Name of the textless root.
ROOT = bytes(16)

SEQUENCE = "conv_id long, mark binary, words long"
PARTIAL = pa.schema([("part", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def marked(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: empty), mark (16 bytes that stand for role and text) and words of the text. Rows
    without a conv_id belong to no conversation and are left out; so are columns of other names."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("*", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("mark"), word_count(F.col("text")).alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, mark, words: each conversation's turns in order (null first; equal turns by role, then text), all in one partition."""
    rows = marked(conversations).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "mark", "words")


def rebuilt_sequences(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """sequences() of rebuilt conversations: c has the first h turns of conversation c - c % every, then its own after its
    first h, with h the crc32 of c's decimal modulo heads. A conversation that is left without turns is one row with a null mark."""
    base = F.col("conv_id") - F.col("conv_id") % every
    rows = marked(conversations).withColumn("base", base).withColumn("own", F.col("conv_id") != base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    rows = rows.repartition("base").sortWithinPartitions("base", "own", "conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, head, conv, seen, out = None, [], None, 0, []
        turnless = False

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [])
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["conv_id", "mark", "words"])
            out.clear()
            return batch

        for batch in batches:
            for b, c, h, mark, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != base:
                    base, head = b, []
                if c != conv:
                    if turnless:
                        out.append((conv, None, 0))
                    conv, seen, turnless = c, 0, True
                    if c != b and h:
                        out += [(c, *turn) for turn in head[:h]]
                        turnless = not head
                seen += 1
                if c == b and len(head) < heads - 1:
                    head.append((mark, words))
                if c == b or seen > h:
                    out.append((c, mark, words))
                    turnless = False
            yield flush()
        if turnless:
            out.append((conv, None, 0))
            yield flush()

    return rows.select("base", "conv_id", "h", "mark", "words").mapInArrow(rebuild, SEQUENCE)


def partial_tries(rows: DataFrame) -> DataFrame:
    """The partial node tables of all tasks: rows of nodes (block is null) and of ends (block and ends only)."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, ends, held = TaskContext.get().partitionId(), {}, defaultdict(list), 0

        def table() -> pa.RecordBatch:
            own = [(part, node, *rest, None, None) for node, rest in nodes.items()]
            own += [(part, node, None, None, None, 0, None, block, ids) for (node, block), ids in ends.items()]
            nodes.clear()
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*own, strict=True), PARTIAL, strict=True)], schema=PARTIAL)

        def visit(node: bytes, parent: bytes | None, depth: int, words: int, conv: int) -> None:
            known = nodes.get(node)
            if known is None:
                nodes[node] = [parent, depth, words, 1, conv]
            else:
                known[3] += 1
                known[4] = min(known[4], conv)

        conv, path, depth = None, ROOT, 0
        for batch in batches:
            for c, mark, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    if conv is not None:
                        ends[path, conv >> BLOCK_BITS].append(conv)
                        held += 1
                    conv, path, depth = c, ROOT, 0
                    visit(ROOT, None, 0, 0, c)
                if mark is not None:
                    before, path, depth = path, xxhash.xxh3_128_digest(path + mark), depth + 1
                    visit(path, before, depth, words, c)
                if held + len(nodes) >= MOST_HELD:
                    yield table()
                    held = 0
        if conv is not None:
            ends[path, conv >> BLOCK_BITS].append(conv)
        if nodes or ends:
            yield table()

    return rows.mapInArrow(tables, "part int, node binary, parent binary, depth long, words long, n long, conv_id long, block long, ends array<long>")


def merged(rows: DataFrame, keys: list[str], sums: list, parts: int) -> DataFrame:
    """One row per keys: rounds of FAN partial tables to one."""
    while parts > FAN:
        rows = rows.withColumn("part", F.expr(f"part div {FAN}")).groupBy(*keys, "part").agg(*sums)
        parts = -(-parts // FAN)
    return rows.groupBy(*keys).agg(*sums)


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the blocks of a node, in order, go through its digest one after the other."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for x, ids in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
                text = ",".join(map(str, ids.as_py())).encode()
                if x == node:
                    sha.update(b"," + text)
                    continue
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = x, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "block").select("node", "ends").mapInArrow(digest, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """node, leaves, saved: sums of both columns over each node's subtree, from node, up (its parent), leaves, saved."""
    at = nodes
    while True:
        below = at.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        # The root has no parent: the many nodes right below a pointer to it need no join.
        high = at.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        far = (F.col("up").isNotNull()) & (F.col("up") != F.lit(ROOT))
        jumped = at.filter(far).join(high, "up").select("node", F.col("_up").alias("up"), "leaves", "saved")
        done = at.filter(~F.coalesce(far, F.lit(False))).select("node", F.lit(None).cast("binary").alias("up"), "leaves", "saved")
        both = jumped.unionByName(done).join(below, "node", "left")
        at = save(both.select("node", "up", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))
        if at.filter("up is not null").isEmpty():
            return at.select("node", "leaves", "saved")


def trie(rows: DataFrame) -> DataFrame:
    """The trie of sequences: node, parent (names; the root's parent is null), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    rows: conv_id, mark, words, each conversation's rows one after the other in one partition (sequences, rebuilt_sequences). A null mark is no turn: a
    conversation of that row alone ends at the root. Turns that repeat are turns of their own; equal conversations are members and ends of the same
    nodes. A conversation of any length is walked with bounded memory, by one task; a text of any length is 16 bytes here. No rows give no node, not even the root.
    """
    partial = save(partial_tries(rows))
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    stats = partial.filter("block is null").select("part", "node", "parent", "depth", "words", "n", "conv_id")
    nodes = save(merged(stats, ["node", "parent", "depth", "words"], [F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")], parts))
    ends = merged(partial.filter("block is not null").select("part", "node", "block", "ends"), ["node", "block"], [F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends")], parts)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("_single"))
    full = save(nodes.join(children, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "_single")}))
    shared = full.filter("n > 1").select("node", F.col("parent").alias("up"), (F.col("_single") + (F.col("n_children") == 0).cast("long")).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    first = nodes.filter(F.col("node") == F.lit(ROOT)).select("conv_id").first()
    above = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    low = full.filter(F.col("parent") != F.lit(ROOT)).join(above, "parent")
    high = full.filter(F.col("parent").isNull() | (F.col("parent") == F.lit(ROOT)))
    high = high.withColumn("parent_conv_id", F.when(F.col("parent").isNotNull(), F.lit(first.conv_id if first else None)).cast("long"))
    found = low.unionByName(high).join(rolled_up(shared), "node", "left").join(end_digests(ends), "node", "left")
    return found.select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
