"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so merges never cross from
one marked word into the next: a text is cut before each run of markers, every distinct marked word is
segmented once, and the ids are joined back by position. The result equals the library's encode() of the
whole text.

Texts become pages: some texts with the list of their distinct chunks, and for every place the number of the chunk
that stands there. Only the distinct chunks of each page are shuffled, never their occurrences, and packed: those of
one page that fall into one bucket of the table (a hash of the chunk) are one row. A bucket segments each of its chunks
once, whatever pages it is on, and sends every page its ids; the page, a row itself, takes them by number and then by
position. A page holds at most PAGE_BYTES of text (one text at least), and the number of buckets follows from the bytes
of all texts, so what a task holds does not grow with the table. Pages times buckets grow with its square until rows
hold one chunk each; there are never more rows than distinct chunks of pages.

Pages are made twice, once for their chunks and once for their codes, instead of being written; the rows of docs must
come in the same order both times, as those of files do. A page that is not the same is an error, never a wrong row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch_slices, gather, give_back

MARK = "▁"
#: Text bytes of a page.
PAGE_BYTES = 8 << 20
#: Text bytes to a bucket of the table of distinct chunks; the chunks themselves are a part of that.
BUCKET_BYTES = 8 << 20
#: Text bytes of a page that are cut into chunks at once (one text at least), and distinct chunks that are hashed at once.
CUT_BYTES, HASHED = 1 << 20, 1 << 14
#: Places of a page whose ids are gathered at once (one text at least).
GATHERED = 1 << 18

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def library(model: str) -> sentencepiece.SentencePieceProcessor:
    if model not in _models:
        _models[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _models[model]


def separable(model: str) -> bool:
    """Whether the method holds for this model. Else whole texts are segmented: a normalizer that rewrites texts or
    drops spaces would see chunks differently."""
    own = library(model)
    pieces = (own.id_to_piece(i) for i in range(own.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces) and own.encode(" ", out_type=str) == [MARK * 2] and own.decode(own.encode("ﬁ①")) == "ﬁ①"


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts one after the other, a space for each marker, and how many each text has. The library
    puts a marker before every text but the empty one."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), MARK, " ")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    _, ends, data = marked.buffers()
    ends = np.frombuffer(ends, np.int32)[marked.offset : marked.offset + len(marked) + 1]
    space = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] == 32 if data is not None else np.zeros(0, bool)
    first = space.copy()
    np.greater(space[1:], space[:-1], out=first[1:])
    first[(ends[:-1] - ends[0])[ends[1:] > ends[:-1]]] = True
    at = np.flatnonzero(first).astype(np.int32)
    offsets = np.append(at + ends[0], ends[-1]).astype(np.int32)
    counts = np.diff(np.searchsorted(at, ends - ends[0]))
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), data if data is not None else pa.py_buffer(b"")), counts


def segmented(chunks: list[str], model: str) -> list[bytes]:
    """The ids of each chunk as little-endian 32-bit integers. Each goes into the library without its first marker,
    which the library puts there; for a chunk of one marker it does not."""
    own = library(model)
    lone = [own.piece_to_id(MARK)]
    return [np.array(ids if chunk != " " else lone, "<i4").tobytes() for chunk, ids in zip(chunks, own.encode([c[1:] for c in chunks], num_threads=1), strict=True)]


def to_planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four planes of bytes, which compress better."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """The number of the chunk at each place of a page, how many places each text has, the distinct chunks as they come, and
    a digest of the text. Texts are cut CUT_BYTES at a time, so that a page's memory is its chunks and their numbers."""
    found, counts, digest = [], [], xxhash.xxh64()
    for part in batch_slices(iter([pa.RecordBatch.from_arrays([texts], ["_text"])]), "_text", CUT_BYTES):
        chunks, n = chunks_of(part.column("_text"))
        digest.update(chunks.buffers()[2])
        found.append(chunks)
        counts.append(n)
    coded = pc.dictionary_encode(pa.chunked_array(found, pa.string())).chunks
    place = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded)])
    # All parts have one dictionary; there is none where no text has a chunk.
    return place, np.concatenate(counts), coded[-1].dictionary if coded else pa.array([], pa.string()), digest.intdigest() - 2**63


def _numbered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    """Per page: its name (task and place in the task), a digest of its text, the rows, the chunks of each row, the number
    of the chunk at each place, the distinct chunks by number (commonest first) and the bucket of each."""
    task = TaskContext.get().partitionId() << 32
    for at, part in enumerate(batch_slices(batches, "_text", PAGE_BYTES)):
        place, counts, chunks, digest = _coded(part.column("_text"))
        order = np.argsort(-np.bincount(place, minlength=len(chunks)), kind="stable")
        number = np.empty(len(order), "<u4")
        number[order] = np.arange(len(order), dtype="<u4")
        codes, chunks = number[place], chunks.take(pa.array(order))
        del place, order, number
        bucket = np.empty(len(chunks), "<u4")
        for start in range(0, len(chunks), HASHED):
            some = chunks.slice(start, HASHED).to_numpy(zero_copy_only=False)
            bucket[start : start + HASHED] = pd.util.hash_array(some, categorize=False) % buckets
        give_back()
        yield task + at, digest, part, counts, codes, chunks, bucket
    give_back()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of keep, and ids array<int>, as the library encodes each whole text without
    begin or end ids. docs is read three times (its bytes, its chunks, its codes) and must give its rows in one order.

    Null and empty texts have an empty list, also where a page or a partition holds no other. Repeated rows are encoded each; rows come in no given order. A very long
    text is a page of its own. An empty table gives an empty table. Columns that are not asked for are left out, so none can clash.
    """
    rest = [id_col, *(c for c in keep if c != id_col)]
    source = docs.select(*(docs[c] for c in rest), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))

    if not separable(model):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batch_slices(batches, "_text"):
                ids = [np.array(library(model).encode(t or ""), "<i4") for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists(np.concatenate(ids), np.array([len(x) for x in ids]))], [*rest, "ids"])

        return source.mapInArrow(whole, schema)

    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    each = T.StructType([source.schema[c] for c in rest])
    page = T.StructType([T.StructField("page", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("rows", T.ArrayType(each)), *(T.StructField(c, T.BinaryType()) for c in ("words", "codes", "buckets"))])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, digest, part, counts, codes, _, bucket in _numbered(batches, buckets):
            rows = pa.StructArray.from_arrays([part.column(c) for c in rest], fields=[part.schema.field(c) for c in rest])
            rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            squeezed = [pa.array([squeeze(to_planes(x))], pa.binary()) for x in (counts, codes, bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest]), rows, *squeezed], ["page", "digest", "rows", "words", "codes", "buckets"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for name, digest, _, _, _, chunks, bucket in _numbered(batches, buckets):
            order = np.argsort(bucket, kind="stable")
            chunks = pa.concat_arrays([chunks.take(pa.array(order))])
            ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1] if len(chunks) else np.zeros(1, np.int32)
            data = memoryview(chunks.buffers()[2] or b"")
            present, first = np.unique(bucket[order], return_index=True)
            last = np.append(first, len(order))[1:]  # none where no text of the page has a chunk
            packed = [squeeze(to_planes(np.diff(ends[a : b + 1])) + data[ends[a] : ends[b]]) for a, b in zip(first, last, strict=True)]
            columns = [pa.array(present.astype(np.int64)), pa.array(np.full(len(present), name)), pa.array(np.full(len(present), digest)), pa.array((last - first).astype(np.int64)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "page", "digest", "n", "chunks"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, opened = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        table: dict[str, bytes] = {}
        for batch in batches:
            packed = []
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("chunks"), strict=True):
                blob = opened(blob.as_py())
                offsets = np.concatenate([[0], np.cumsum(of_planes(blob[: 4 * n]))]).astype(np.int32)
                chunks = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(blob[4 * n :])).to_pylist()
                new = [c for c in chunks if c not in table]
                table.update(zip(new, segmented(new, model), strict=True))
                known = [table[c] for c in chunks]
                packed.append(squeeze(to_planes(np.fromiter(map(len, known), np.int64, n) // 4) + to_planes(np.frombuffer(b"".join(known), "<u4"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "page", "digest", "n")), pa.array(packed, pa.binary())], ["bucket", "of", "digest", "n", "ids"])
        table.clear()
        give_back()

    def fill(page: pa.Table, known: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor().decompress
        bucket = of_planes(opened(page.column("buckets")[0].as_py())) if page.num_rows else []
        if page.num_rows != 1 or sum(known.column("n").to_pylist()) != len(bucket) or set(known.column("digest").to_pylist()) - {page.column("digest")[0].as_py()}:
            raise ValueError("docs gave other rows, or another order of them, when it was read again: write it to a table first")
        known = known.sort_by("bucket")
        runs, flat = np.zeros(len(bucket), np.int64), [np.zeros(0, "<u4")]
        order, done = np.argsort(bucket, kind="stable"), 0
        for n, blob in zip(known.column("n").to_pylist(), known.column("ids"), strict=True):
            blob = opened(blob.as_py())
            runs[order[done : done + n]] = of_planes(blob[: 4 * n])
            flat.append(of_planes(blob[4 * n :]))
            done += n
        start = np.zeros(len(bucket), np.int64)
        start[order] = np.cumsum(runs[order]) - runs[order]
        place = of_planes(opened(page.column("codes")[0].as_py()))
        words = np.concatenate([[0], np.cumsum(of_planes(opened(page.column("words")[0].as_py())), dtype=np.int64)])
        rows, flat = page.column("rows").combine_chunks().flatten(), np.concatenate(flat).view("<i4")
        parts, at = [], 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(words, words[at] + GATHERED, "right")) - 1)
            here = place[words[at] : words[to]]
            sizes = np.concatenate([[0], np.cumsum(runs[here])])
            ids = lists(gather(flat, start, runs, here), np.diff(sizes[words[at : to + 1] - words[at]]))
            parts.append(pa.RecordBatch.from_arrays([*(rows.field(c).slice(at, to - at) for c in rest), ids], [*rest, "ids"]))
            at = to
        return pa.Table.from_batches(parts)

    back = source.mapInArrow(shares, "bucket long, page long, digest long, n long, chunks binary").groupBy("bucket").applyInArrow(segment, "bucket long, of long, digest long, n long, ids binary")
    return source.mapInArrow(pages, page).groupBy("page").cogroup(back.groupBy("of")).applyInArrow(fill, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with out_col string, the library's decode() of ids_col; null ids give null. Repeated rows are decoded
    each; a list of any length is decoded whole."""
    rest = [c for c in encoded.columns if c != out_col]
    source = encoded.select(*rest)
    schema = T.StructType([*source.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(ids_col).to_pylist()
                texts = [None if x is None else own.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*rest, out_col])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: n_tokens, and hex digests of the ids and of the text decoded from them. Null and empty texts have no ids
    and the digests of nothing."""
    done = decode(encode(docs, model), model)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
