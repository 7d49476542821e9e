"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets of similarity t and more share, in the first |x| - ceil(t|x|) + l tokens of any global order, at
least l tokens. Every document picks its own l: its prefix is lengthened while the estimated work (postings
to read, and candidates to verify, which fall with l) gets less. How many prefix tokens a pair has to share before
its sets are verified follows from both prefixes and sizes: the longer the prefixes, the more.

The order puts rare shingles first, by their exact document frequencies: all shingles of all sets are dealt
by hash range as packed runs, and each range gives back the shingles that two sets or more hold. A set's
other shingles match nothing, so what it shares at most is known before any pair is made: sets with too few
shared shingles, nearly all of a corpus, leave here, and a pair is only made where the sizes and shared shingles of
both still allow the similarity. Shingles that a sketch of fixed size finds very frequent have
no need of counting; they spread over all ranges and come last in the order.

Groups of copies settle in rounds with one pair a set: in every posting list each set is verified against
the set of the list that has the fewest shingles of its own (in a near-copy group the one nearest to what all have in common)
and against its neighbour by size; then, until nothing new is linked, one set of each component of
a list against one of the list's best. Only lists that still span several components are then joined, each list's main
component against the rest, so no pair inside a component is ever made. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drop_saved, give_back, save, text_slices
from tidemark.llm.components import components

#: Count sketch that finds very frequent shingles: rows x counters (8 MB as 32-bit numbers, whatever the input), sent in blocks.
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCK = 2, 20, 1 << 13
#: A shingle is very frequent from so many sets on, and from so many times the sketch's mean counter.
FREQUENT, ABOVE_NOISE = 1 << 13, 8
#: Shingles of a hash range, and the most ranges (larger inputs get larger ranges).
RANGE_SHINGLES, MOST_RANGES = 1 << 18, 1 << 18
#: Largest l, and shingles read in verifying that cost as much as one posting.
MOST_MATCHES, POSTINGS_PER_SHINGLE = 8, 8
#: Sets of a list from which it is spread over several tasks.
HOT_LIST = 1000
#: Bits of a set's parity, which rules out pairs in the last join before they are made.
PARITY_BITS = 512
#: Rounds that join the components of a list by one pair each.
STAR_ROUNDS = 3

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Text bytes hashed at once, about what a core's cache holds.
HASH_BYTES = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# A number for each byte, A-Z as a-z; a word's hash is the polynomial of its bytes' numbers in an odd base.
_BYTE = np.random.default_rng(41).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n, 2 * HASH_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[k]
    return h ^ (h >> np.uint64(29))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    data = np.frombuffer(raw, np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    forth, back = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * forth[: len(data)], out=sums[1:])
    return start, _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64), 2)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Per whole text, the sorted distinct 64-bit hashes of its shingles in ASCII lower case; a text with fewer
    words is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        ends = np.cumsum([len(x) + 1 for x in group])
        start, word = _words(b"\n".join(group))
        cuts = np.concatenate([[0], np.searchsorted(start, ends)])
        h = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            h = _mix(h + word[k : len(word) - width + 1 + k], k % len(_ODD))
        h = _mix(h, 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= width:
                x = np.sort(h[a : b - width + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif b > a:
                x = np.array([b - a], np.uint64)
                for w in word[a:b]:
                    x = _mix(x + w, 3)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
        group.clear()

    for text in texts:
        raw = text.encode() if text else b""
        if group and held + len(raw) > HASH_BYTES:
            flush()
            held = 0
        group.append(raw)
        held += len(raw) + 1
    if group:
        flush()
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def node_of(found: np.ndarray) -> int:
    """Name of a set: equal sets have equal names."""
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True)


def _slots(found: np.ndarray, row: int) -> np.ndarray:
    return ((found * _ODD[row + 1]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each of PARITY_BITS places, as longs. Two sets' parities differ in
    no more places than the sets differ in tokens."""
    place = ((found * _ODD[0]) >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY_BITS) & 1).astype(bool)).view(np.int64)


def census(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, node (null for an empty set) and parity per row, and the sketch of all shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", "parity", "slot", "counts"]
        sums = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for part, texts in text_slices(batches, "_text"):
            sets = shingle_sets(texts, width)
            every = np.concatenate(sets)
            for r in range(SKETCH_ROWS):
                sums[r] += np.bincount(_slots(every, r), minlength=1 << SKETCH_BITS)
            n, node = [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets]
            none, size = pa.nulls(len(sets)), PARITY_BITS // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * size), pa.array(np.concatenate([parity(x) for x in sets])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), bits, none.cast(pa.int32()), none.cast(pa.binary())], names)
        blocks = [(i, b) for i, b in enumerate(sums.reshape(-1, SKETCH_BLOCK)) if b.any()]
        none = pa.nulls(len(blocks)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(blocks), pa.list_(pa.int64())), pa.array([i for i, _ in blocks], pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for _, b in blocks], pa.binary())], names)
        del sums, blocks
        give_back()

    rows = save(docs.mapInArrow(run, "doc_id long, n long, node long, parity array<long>, slot int, counts binary"))

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in frame["counts"])
        return pd.DataFrame({"slot": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = rows.filter("slot is not null").select("slot", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("_share"))
    parts = parts.groupBy("slot", "_share").applyInPandas(add, "slot int, counts binary").groupBy("slot").applyInPandas(add, "slot int, counts binary")
    sketch = np.zeros((SKETCH_ROWS << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.uint32).reshape(-1, SKETCH_BLOCK)
    for slot, counts in parts.toPandas().itertuples(index=False):
        sketch[slot] = np.minimum(np.frombuffer(zlib.decompress(counts), np.int64), 0xFFFFFFFF)
    return rows.filter("slot is null").select("doc_id", "n", "node", "parity"), sketch.reshape(SKETCH_ROWS, -1)


def estimate(found: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """At least the number of sets that hold each shingle."""
    count = sketch[0][_slots(found, 0)]
    for r in range(1, SKETCH_ROWS):
        count = np.minimum(count, sketch[r][_slots(found, r)])
    return count


def shared_shingles(texts: DataFrame, sketch: np.ndarray, ranges: int, width: int) -> DataFrame:
    """token, node, df: the shingles of every set that another set holds too, and how many sets hold them.

    Shingles are dealt by hash range; a task packs those of a slice of texts for one range into one row
    (6 bytes a shingle, the range stands for the first bits). Very frequent shingles are dealt by set as
    well, so no range gets much more than its share; their df is the sketch's.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    spread = np.uint64(ranges)
    high = lambda h: (((h >> np.uint64(32)) * spread) >> np.uint64(32)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        least = max(FREQUENT, ABOVE_NOISE * float(counts[0].mean()))
        for _, some in text_slices(batches, "_text"):
            sets, names = [], []
            for found in shingle_sets(some, width):
                if len(found) and (node := node_of(found)) not in seen:
                    seen.add(node)
                    sets.append(found)
                    names.append(node)
            if not sets:
                continue
            every, names = np.concatenate(sets), np.array(names, np.int64)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            frequent = estimate(every, counts) >= least
            place = high(every) * 2
            place[frequent] = high(_mix(every[frequent] ^ names[owner[frequent]].view(np.uint64), 3)) * 2 + 1
            order = np.argsort(place, kind="stable")
            place, every, owner = place[order], every[order], owner[order]
            cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                runs = np.concatenate([[a], np.flatnonzero(owner[a + 1 : b] != owner[a : b - 1]) + a + 1, [b]])
                size = 8 if place[a] & 1 else 6
                tokens = every[a:b].view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                rows.append((int(place[a]) >> 1, bool(place[a] & 1), tokens, names[owner[runs[:-1]]].tobytes(), np.diff(runs).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["range", "frequent", "tokens", "nodes", "runs"])
        give_back()

    def unique(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in order, each once: several tasks may have sent an equal set."""
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        return tokens[new], nodes[new]

    def several(tokens: np.ndarray, nodes: np.ndarray, first: np.uint64) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        again = np.zeros(len(tokens), bool)
        again[1:] = tokens[1:] == tokens[:-1]
        again[:-1] |= again[1:]
        tokens, nodes = unique(tokens[again], nodes[order[again]])
        _, back, df = np.unique(tokens, return_inverse=True, return_counts=True)
        df = df[back]
        tokens = _mix(tokens[df > 1] ^ first, 0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(nodes[df > 1]), pa.array(df[df > 1].astype(np.int64))], ["token", "node", "df"])

    def frequent_ones(tokens: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        tokens, nodes = unique(tokens, nodes)
        df = estimate(tokens, shared.value).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(_mix(tokens, 1).view(np.int64)), pa.array(nodes), pa.array(df)], ["token", "node", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, often = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from several(*map(np.concatenate, zip(*held, strict=True)), _mix(np.array([now], np.uint64), 2))
            if often:
                yield from frequent_ones(*map(np.concatenate, zip(*often, strict=True)))
            held.clear(), often.clear()

        for batch in batches:
            for at, frequent, tokens, nodes, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    yield from close()
                now = at
                nodes = np.repeat(np.frombuffer(nodes, np.int64), np.frombuffer(runs, np.uint32))
                if frequent:
                    often.append((np.frombuffer(tokens, np.uint64), nodes))
                else:
                    wide = np.zeros((len(nodes), 8), np.uint8)
                    wide[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
                    held.append((wide.view(np.uint64).reshape(-1), nodes))
        yield from close()
        give_back()

    dealt = texts.mapInArrow(deal, "range int, frequent boolean, tokens binary, nodes binary, runs binary")
    ordered = dealt.repartition("range").sortWithinPartitions("range")
    return ordered.mapInArrow(count, "token long, node long, df long")


def length(n: int, df: np.ndarray, percent: int) -> int:
    """How many of a set's shared shingles, rarest first, its prefix takes: those of the l of the least cost.
    n: size of the set; df: in how many sets each shared shingle is."""
    need = -(-percent * n // 100)
    first, most = n - need + 1 - (n - len(df)), min(MOST_MATCHES, need)
    postings = np.cumsum(np.maximum(df[: first + most - 1] - 1.0, 0.0))[first - 1 :]
    matches = np.arange(1, len(postings) + 1)
    return first + int(np.argmin(postings + postings / matches * n / POSTINGS_PER_SHINGLE))


def able(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The sets that share enough with others to be similar to one of them: node, n, parity, v (shared shingles), tokens and df of the shared
    shingles, rarest first, and p, the length of the prefix of tokens."""
    each = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    rows = each.join(nodes.select("node", "n", "parity"), "node").filter(100 * F.size("t") >= percent * F.col("n"))
    rows = rows.select("node", "n", "parity", F.size("t").cast("long").alias("v"), F.col("t.token").alias("tokens"), F.col("t.df").alias("df"))
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("df")
            ends, df = lists.offsets.to_numpy(), lists.values.to_numpy()
            p = [length(n, df[a:b], percent) for n, a, b in zip(batch.column("n").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.int32())], [*batch.schema.names, "p"])

    return rows.mapInArrow(run, schema)


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that reach the similarity. Pairs whose prefixes share too few tokens are
    given up before their sets are compared: of an overlap of t, all but n_x - v_x - p_x less come in the prefix of x."""
    side = lambda c: sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "v", "p", "tokens")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    start = lambda c: F.slice(f"{c}_tokens", F.lit(1), F.col(f"{c}_p"))
    need = least_overlap(F.col("a_n"), F.col("b_n"), percent)
    rest = F.greatest(F.col("a_v") - F.col("a_p"), F.col("b_v") - F.col("b_p"))
    near = (F.size(F.array_intersect(start("a"), start("b"))) >= need - rest) & (F.size(F.array_intersect("a_tokens", "b_tokens")) >= need)
    return save(both.filter(near).select("a", "b"))


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Tokens that sets of n and m have to share to be similar, in whole numbers."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - 1e-9)


def possible(percent: int, n: str = "n", v: str = "v", m: str = "q_n", w: str = "q_v") -> Column:
    """Whether sets of these sizes (n, m), of which others share so much (v, w), can be similar."""
    return F.least(v, w) >= least_overlap(F.col(n), F.col(m), percent)


def links_of(sets: DataFrame, percent: int) -> DataFrame:
    """node, component for every set of sets that is similar to another."""
    each = sets.select("node", "n", "v", (F.col("v") - F.col("p")).alias("rest"), F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), F.col("p")).alias("token"), F.slice("df", F.lit(1), F.col("p")).alias("df"))).alias("t"))
    each = each.select(F.col("t.token").alias("token"), F.col("t.df").alias("df"), "node", "n", "v", "rest")
    # A list longer than HOT_LIST is cut into pieces by set.
    pieces = F.greatest(F.floor(F.col("df") / HOT_LIST), F.lit(1))
    each = each.withColumn("salt", F.pmod(F.xxhash64("node", "token"), pieces).cast("int")).withColumn("pieces", pieces.cast("int")).drop("df")
    place = Window.partitionBy("token", "salt")
    before = lambda c: F.lag(c).over(place.orderBy("n", "node"))
    # Own shingles in a million: the set with the fewest stands for the list.
    own = (F.col("n") - F.col("v")) * 1_000_000 / F.col("n")
    each = each.withColumn("key", F.struct(own.cast("long").alias("own"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("v").alias("v")))
    lists = each.select("*", before("node").alias("p"), before("n").alias("p_n"), before("v").alias("p_v"), F.min("key").over(place).alias("best"), F.count("*").over(place).alias("_in"))
    lists = save(lists.filter("_in > 1 or pieces > 1").drop("_in"))
    star = lists.select("node", "n", "v", F.col("best.node").alias("q"), F.col("best.n").alias("q_n"), F.col("best.v").alias("q_v"), F.lit(0).alias("kind"))
    side = lists.filter("p is not null").select("node", "n", "v", F.col("p").alias("q"), F.col("p_n").alias("q_n"), F.col("p_v").alias("q_v"), F.lit(1).alias("kind"))
    near = star.unionByName(side).filter((F.col("q") != F.col("node")) & possible(percent)).groupBy("node", "kind", "q").count()
    near = near.groupBy("node", "kind").agg(F.max_by("q", F.struct("count", "q")).alias("q"))
    pairs = save(near.select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct())
    tried, known = pairs, components(verified(sets, pairs, percent))

    for _ in range(STAR_ROUNDS):
        # One set of each component of a list, against the best of the list's other components.
        placed = lists.select("token", "node", "key").join(known, "node", "left").select("token", "key", F.coalesce("component", "node").alias("c"))
        heads = placed.groupBy("token", "c").agg(F.min("key").alias("key"))
        first = heads.groupBy("token").agg(F.min(F.struct("key", "c")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
        met = heads.join(first, "token").filter("c != m.c")
        met = met.select(F.col("key.node").alias("node"), F.col("key.n").alias("n"), F.col("key.v").alias("v"), F.col("m.key.node").alias("q"), F.col("m.key.n").alias("q_n"), F.col("m.key.v").alias("q_v"))
        met = met.filter(possible(percent)).select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct()
        pairs = save(met.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        more = verified(sets, pairs, percent)
        if more.isEmpty():
            break
        tried, known = tried.unionByName(pairs), joined(known, more)

    own = save(lists.select("token", "pieces", "node", "n", "v", "rest").join(known, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"))
    spans = own.groupBy("token", "c").agg(F.count("*").alias("count")).groupBy("token").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_lists = own.join(spans, "token")
    open_lists = save(open_lists.join(sets.select("node", "parity"), "node"))
    piece = F.pmod(F.xxhash64("node", "token"), "pieces")
    rest = open_lists.filter("c != main").select(F.col("token").alias("q_token"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q_piece"), *(F.col(x).alias(f"q_{x}") for x in ("node", "n", "v", "rest", "c", "parity")))
    here = open_lists.withColumn("piece", piece.cast("int"))
    # Sets that can be similar differ in few tokens, and so their parities in few places.
    apart = F.lit(0)
    for i in range(PARITY_BITS // 64):
        apart = apart + F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("q_parity")[i]))
    wanted = (F.col("q_token") == F.col("token")) & (F.col("q_piece") == F.col("piece")) & (F.col("q_c") != F.col("c")) & ((F.col("c") == F.col("main")) | (F.col("q_node") < F.col("node")))
    pairs = rest.join(here, wanted & possible(percent) & (apart <= F.col("n") + F.col("q_n") - 2 * least_overlap(F.col("n"), F.col("q_n"), percent)))
    pairs = pairs.groupBy(F.least("node", "q_node").alias("a"), F.greatest("node", "q_node").alias("b"), (F.col("n") + F.col("q_n")).alias("sizes"), F.greatest("rest", "q_rest").alias("most")).agg(F.countDistinct("token").alias("count"))
    # What the prefixes share in all decides whether a pair is worth its verification.
    pairs = pairs.filter(F.col("count") >= least_overlap(F.col("sizes"), F.lit(0), percent) - F.col("most")).select("a", "b")
    pairs = save(pairs.join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        known = joined(known, verified(sets, pairs, percent))
    drop_saved(lists)
    drop_saved(own)
    drop_saved(open_lists)
    return known


def joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components of more links; those found before stand in for the links they came from."""
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def groups(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, n, node, parity; and per node: node, doc (its smallest doc_id), component_id.

    percent: the least intersection in a hundred of the union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    rows, sketch = census(docs, width)
    nodes = save(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    every = nodes.agg(F.sum("n")).first()[0] or 0
    ranges = min(max(1, every // RANGE_SHINGLES), MOST_RANGES)
    sets = save(able(shared_shingles(docs.select("_text"), sketch, ranges, width), nodes, percent))
    known = links_of(sets, percent)
    nodes = save(nodes.join(known, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component")))
    smallest = nodes.join(known.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("doc").alias("_least"))
    return rows, save(nodes.join(smallest, "component", "left").select("node", "doc", F.coalesce("_least", "doc").alias("component_id")))


def join_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null, empty and white-space texts have an empty set and link with nothing. Equal texts and repeated
    rows link. A row without doc_id takes the smallest doc_id of its component, if any. An empty table
    gives an empty table; extra columns are left out.
    """
    rows, nodes = groups(docs, width, percent)
    out = rows.join(nodes.select(F.col("node").alias("_node"), "component_id"), F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns; documents
    with an empty set all stay. Rows that repeat a kept doc_id with an equal set are one document."""
    columns = docs.columns
    _, nodes = groups(docs, width, percent)
    kept = nodes.filter(F.col("doc").eqNullSafe(F.col("component_id"))).select(F.col("node").alias("_keep"), F.col("doc").alias("_doc"))
    source = docs.select(F.struct(*(docs[c] for c in columns)).alias("_in"), docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text"))
    schema = T.StructType([source.schema["_in"], T.StructField("_id", T.LongType()), T.StructField("_node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text"):
            sets = shingle_sets(texts, width)
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_in"), part.column("_id"), node], ["_in", "_id", "_node"])

    # Rows without a set get keys of their own: they spread over all tasks and none counts as a repeat.
    alone = F.xxhash64(F.monotonically_increasing_id(), F.lit("alone"))
    rows = source.mapInArrow(run, schema).withColumn("_key", F.coalesce("_node", alone))
    rows = rows.join(kept, F.col("_key") == F.col("_keep"), "left")
    rows = rows.filter(F.col("_node").isNull() | (F.col("_keep").isNotNull() & F.col("_id").eqNullSafe(F.col("_doc")))).dropDuplicates(["_key"])
    return rows.select(*(F.col("_in")[c].alias(c) for c in columns))
