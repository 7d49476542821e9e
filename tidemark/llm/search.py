"""Ranked lexical search: the best documents for each query text, over inverted treaps.

An index row is a shard: some documents with, for each term, its postings (place of the document, occurrences). A shard's
postings of one term make a treap: a search tree by the document's place (documents go by id), a heap by impact, so the
root of any subtree has its highest impact. A query walks the treaps of its terms at the same time. The stretch of all
documents has a node of each treap, the root; the sum of weight times impact over these nodes bounds every score in the
stretch. While it can reach the top k, the document of the node with the largest share is scored, and parts the
stretch in two; each treap descends to its highest node inside either part. Stretches that cannot reach the k-th best score found
so far (in this task, also in other shards) go with all their subtrees. All stretches of a step are handled at once, as
arrays.

Shards are made where the documents are read, so postings are never shuffled; of each task only k documents a query are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, gather, save

# What parts terms (all ASCII but letters and digits), and A-Z for lower-casing.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed values of the impact: scale, the share of the length in per cent, and the saturation.
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 25, 12

#: Documents and postings that a task puts into one set of treaps (a shard of the index at least).
TREAP_DOCS, TREAP_POSTINGS = 1 << 14, 3_000_000
#: Cells (stretches times terms) of a step.
STEP_CELLS = 1 << 21
#: Query text that is handled in one pass over the index; the queries of more text take more passes.
BLOCK_BYTES = 1 << 20


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def build_index(docs: DataFrame, terms: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the index, restricted to postings of the given terms: doc_ids, sizes (all terms of each document, with repeats), names (the
    terms), counts (documents of each) and postings (compressed places and occurrences). Every document is in one shard."""
    order = {t: i for i, t in enumerate(sorted(terms))}
    names, wanted = list(order), frozenset(order)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        ids, sizes, found, places, tfs, held = [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            term, place, tf = (np.array(x, np.int64) for x in (found, places, tfs))
            at = np.argsort(term, kind="stable")
            present, counts = np.unique(term, return_counts=True)
            data = squeeze(place[at].astype("<u4").tobytes() + tf[at].astype("<u4").tobytes())
            columns = [pa.array([x], t) for x, t in ((list(ids), pa.list_(pa.int64())), (list(sizes), pa.list_(pa.int64())), ([names[i] for i in present], pa.list_(pa.binary())), (counts.tolist(), pa.list_(pa.int64())), (data, pa.binary()))]
            for x in (ids, sizes, found, places, tfs):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sizes", "names", "counts", "postings"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or b""
                words = terms_of(text)
                tally = Counter(words)
                for t in tally.keys() & wanted:
                    found.append(order[t])
                    places.append(len(ids))
                    tfs.append(tally[t])
                ids.append(doc)
                sizes.append(len(words))
                held += len(text)
                if held >= SLICE_BYTES * 4 or len(ids) >= TREAP_DOCS:
                    yield row()
                    held = 0
        if ids:
            yield row()

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    return source.mapInArrow(shard, "doc_ids array<long>, sizes array<long>, names array<binary>, counts array<long>, postings binary")


def statistics(index: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, the documents with a term; L, all terms with repeats; and of each of the given terms its documents."""
    n, total = index.select(F.size(F.filter("sizes", lambda x: x > 0)).alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    pairs = index.select(F.explode(F.arrays_zip("names", "counts")).alias("t")).groupBy("t.names").agg(F.sum("t.counts").alias("n"))
    return n or 0, total or 0, {bytes(t): c for t, c in pairs.collect()}  # one row for each of the given terms


def children(keys: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left and right child of every posting and the root of every term; keys are the heap order, in the order of places
    within each term, starts where the terms begin. None is len(keys)."""
    n = len(keys)
    left, right, roots = [n] * n, [n] * n, []
    for a, b in zip(starts, [*starts, n][1:], strict=True):
        stack = []
        for i in range(a, b):
            key, last = keys[i], n
            while stack and keys[stack[-1]] < key:
                last = stack.pop()
            left[i] = last
            if stack:
                right[stack[-1]] = i
            stack.append(i)
        roots.append(stack[0])
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


class Treaps:
    """The treaps of some shards of the index."""

    def __init__(self, shards: list[tuple], number: dict[bytes, int], n_docs: int, total: int) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        ids = [x for s in shards for x in s[0]]
        self.missing = np.array([x is None for x in ids])
        self.ids = np.array([x or 0 for x in ids], np.int64)
        order = np.lexsort((self.ids, self.missing))
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        self.ids, self.missing = self.ids[order], self.missing[order]
        sizes = np.array([x for s in shards for x in s[1]], np.int64)[order]
        term, place, tf, before = [], [], [], 0
        for own, _, names, counts, data in shards:
            both = np.frombuffer(unpack(data), "<u4").astype(np.int64)
            place.append(place_of[both[: len(both) // 2] + before])
            tf.append(both[len(both) // 2 :])
            term.append(np.repeat(np.array([number[bytes(x)] for x in names], np.int64), counts))
            before += len(own)
        term, place, tf = (np.concatenate(x) for x in (term, place, tf))
        longness = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // max(total, 1)
        at = np.lexsort((place, term))
        term, place, tf = term[at], place[at], tf[at]
        impact = (SCALE * tf) // (1000 * tf + SATURATION * longness[place])
        # Equal impacts are told apart by a mix of the place, else copies of a text would make a chain of a treap.
        mixed = (place * 0x9E3779B1 >> 12) & 0xFFFFF
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.left, self.right, roots = children(((impact << 20) + mixed).tolist(), starts.tolist())
        self.none = len(place)
        self.root = np.full(len(number), self.none, np.int32)
        self.root[term[starts]] = roots
        self.place, self.impact = np.append(place, -1).astype(np.int32), np.append(impact, 0)
        by_doc = np.argsort(place, kind="stable")
        self.doc_term, self.doc_impact = term[by_doc], impact[by_doc]
        self.doc_size = np.bincount(place, minlength=len(order))
        self.doc_start = np.cumsum(self.doc_size) - self.doc_size

    def settle(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Let each node descend to the highest one of its subtree with low < place < high of its row."""
        flat, width = nodes.reshape(-1), nodes.shape[1]
        at = np.flatnonzero(flat != self.none)
        while len(at):
            node, row = flat[at], at // width
            place = self.place[node]
            over = place >= high[row]
            out = over | (place <= low[row])
            at, node, over = at[out], node[out], over[out]
            flat[at] = node = np.where(over, self.left[node], self.right[node])
            at = at[node != self.none]

    def best(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, known: tuple) -> tuple:
        """(scores, ids, whether an id is null) of the k best so far: known with this set's documents. dense has the weights by term."""
        least = lambda b: b[0][k - 1] if len(b[0]) >= k else 1
        here = self.root[terms] != self.none
        terms, weights = terms[here], weights[here]
        todo = [(self.root[terms][None, :], np.array([-1]), np.array([len(self.ids)]))] if len(terms) else []
        while todo:
            nodes, low, high = todo.pop()
            share = self.impact[nodes] * weights
            keep = share.sum(1) >= least(known)
            if not keep.any():
                continue
            nodes, low, high, share = nodes[keep], low[keep], high[keep], share[keep]
            doc = self.place[nodes[np.arange(len(nodes)), share.argmax(1)]]
            size = self.doc_size[doc]
            each = dense[gather(self.doc_term, self.doc_start, self.doc_size, doc)] * gather(self.doc_impact, self.doc_start, self.doc_size, doc)
            score = np.add.reduceat(each, np.cumsum(size) - size)
            new = score >= least(known)
            if new.any():
                both = [np.concatenate(x) for x in zip(known, (score[new], self.ids[doc[new]], self.missing[doc[new]]), strict=True)]
                top = np.lexsort((both[1], both[2], -both[0]))[:k]
                known = tuple(x[top] for x in both)
            nodes, low, high = np.concatenate([nodes, nodes]), np.concatenate([low, doc]), np.concatenate([doc, high])
            self.settle(nodes, low, high)
            alive = (nodes != self.none).any(1)
            nodes, low, high = nodes[alive], low[alive], high[alive]
            step = max(1, STEP_CELLS // max(1, nodes.shape[1]))
            todo += [(nodes[i : i + step], low[i : i + step], high[i : i + step]) for i in range(0, len(nodes), step)][::-1]
        return known


def _candidates(index: DataFrame, queries: list[dict[bytes, int]], k: int) -> DataFrame:
    """no (the query's number), doc_id, score: for each query at least its k best documents."""
    terms = set().union(*queries) if queries else set()
    n_docs, total, df = statistics(index, terms)
    number = {t: i for i, t in enumerate(sorted(df))}
    weight = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * np.array([df[t] for t in number], float) + 1))).astype(np.int64)
    asked = []
    for q in queries:
        own = {number[t]: c * int(weight[number[t]]) for t, c in q.items() if t in number and weight[number[t]] > 0}
        asked.append((np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best, shards, docs, postings = [nothing] * len(asked), [], 0, 0

        def search() -> None:
            treaps, dense = Treaps(shards, number, n_docs, total), np.zeros(len(number), np.int64)
            for i, (own, w) in enumerate(asked):
                dense[own] = w
                best[i] = treaps.best(own, w, dense, k, best[i])
                dense[own] = 0

        for batch in batches:
            for i in range(batch.num_rows):
                own = [c[i].as_py() for c in batch.columns]
                docs, postings = docs + len(own[0]), postings + sum(own[3])
                if shards and (docs > TREAP_DOCS or postings > TREAP_POSTINGS):
                    search()
                    shards, docs, postings = [], len(own[0]), sum(own[3])
                shards.append(own)
        if shards:
            search()
        no = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        score, doc, missing = (np.concatenate(x) if best else np.zeros(0, np.int64) for x in (list(zip(*best, strict=True)) or [[], [], []]))
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())], ["no", "doc_id", "score"])

    return index.mapInArrow(walk, "no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the k documents of the highest score above 0 for each item, fewer if there are no more.

    docs: doc_id, text. Equal scores go by doc_id, null last. Null and empty texts have no terms: such documents are never
    found and such items find nothing. Repeated documents are ranked each, repeated items are searched each. A very long text is
    one document; a very long item has more treaps to walk, in smaller steps. Extra columns are not read. Empty tables give an
    empty table. Items are a set of queries: they are brought to the driver in blocks of BLOCK_BYTES of text, and each block takes
    a pass over docs, whose index it makes for its own terms.
    """
    spark, found = docs.sparkSession, None
    block, size = [], 0

    def pass_over() -> DataFrame:
        queries = [Counter(terms_of(t)) for _, t in block]
        index = save(build_index(docs, set().union(*queries)))
        best = _candidates(index, queries, k)
        order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        own = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"no long, {item_id} {kind}")
        return best.join(F.broadcast(own), "no").select(item_id, F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # a block at most

    kind = items.schema[item_id].dataType.simpleString()
    for row in items.select(items[item_id].alias("i"), items[item_text].cast("binary").alias("t")).toLocalIterator():
        block.append((row.i, bytes(row.t) if row.t is not None else None))
        size += len(row.t or b"") + 64
        if size >= BLOCK_BYTES:
            found = pass_over() if found is None else found.unionByName(pass_over())
            block, size = [], 0
    if block:
        found = pass_over() if found is None else found.unionByName(pass_over())
    return found if found is not None else spark.createDataFrame([], f"{item_id} {kind}, rank int, doc_id long, score long")
