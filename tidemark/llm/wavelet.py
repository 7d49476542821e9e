"""Token ids as one wavelet-matrix file per shard.

A shard holds the ids of consecutive documents as succinct bit planes (most significant first). Each
plane is cut into blocks of BLOCK_BITS bits, compressed one by one, with the count of ones before each
block, so access, counting and occurrence lookup touch a few blocks of the one file.

Layout: magic, 4 bytes of header length, zstd of a JSON header, then the sections the header names:
document ids, document offsets, and for each plane its blocks. All integers are little-endian.

Writing is a range shuffle by document id and one pass; a retried task writes files of its own and the
manifest that Spark commits names the ones that count.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import batch_slices, gather, save, scratch

MAGIC = b"TWM1"
BLOCK_BITS = 1 << 16
#: A shard is closed at so many tokens; one longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: Distinct pieces of words a worker holds before it starts its table anew.
TABLE_WORDS = 500_000

# Latin words, with ASCII punctuation other than the apostrophe behind them.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\\[-`{-~]*$"
_LOWER = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """The tokenizers library's ids of whole texts for a model that drops white space.

    Texts are cut at ASCII white space, which no token crosses. A slice's distinct words are parted in Arrow: plain Latin
    ones into a lower-case stem and the punctuation behind it, which go straight to the library's model, all else goes through its
    pipeline whole. Stems, punctuation and odd words are encoded once per worker, and their ids lie in one array, from which
    those of words and texts are gathered by position.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): bytes_of(c)[0][0] for c in _LOWER}
        self.clear()

    def clear(self) -> None:
        #: Where the ids of each known piece lie: its number, and by number the end in `flat`; number 0 is the empty piece.
        self.known: dict[str, int] = {"": 0}
        self.flat, self.ends = array("I"), array("q", [0])

    def stems(self, pieces: list[str]) -> Iterator[list[int]]:
        tokenize = self.library.model.tokenize
        for piece in pieces:
            yield [t.id for t in tokenize(piece if piece.isascii() else piece.translate(self.spelled))]

    def whole(self, words: list[str]) -> Iterator[list[int]]:
        for start in range(0, len(words), 4096):
            for e in self.library.encode_batch_fast(words[start : start + 4096], add_special_tokens=False):
                yield e.ids

    def numbers(self, pieces: pa.Array, encode: Callable[[list[str]], Iterator[list[int]]]) -> np.ndarray:
        """The number of each piece; those not known yet are encoded."""
        each = pc.dictionary_encode(pieces)
        distinct = each.dictionary.to_pylist()
        known, flat, ends = self.known, self.flat, self.ends
        fresh = [p for p in distinct if p not in known]
        for piece, ids in zip(fresh, encode(fresh), strict=True):
            known[piece] = len(ends)
            flat.extend(ids)
            ends.append(len(flat))
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[each.indices.to_numpy()]

    def pieces(self, words: pa.Array) -> np.ndarray:
        """Two numbers of pieces for each word, one after the other."""
        if len(self.known) > TABLE_WORDS:
            self.clear()
        plain = pc.and_(pc.match_substring_regex(words, _SIMPLE), pc.invert(pc.match_substring(words, "<|")))
        of = plain.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(plain))
        out = np.zeros((len(words), 2), np.int64)
        out[of, 0] = self.numbers(pc.ascii_rtrim(lower, _MARKS), self.stems)
        out[of, 1] = self.numbers(pc.utf8_ltrim(lower, _LOWER), self.stems)
        out[~of, 0] = self.numbers(words.filter(pc.invert(plain)), self.whole)
        return out.ravel()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end; null texts have none."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = pc.dictionary_encode(cut.flatten())
        pieces = self.pieces(numbered.dictionary)
        ends = np.array(self.ends)
        begin = np.concatenate([[0], ends[:-1]])
        lengths = ends - begin
        runs, size = gather(np.array(self.flat, np.uint32), begin, lengths, pieces), lengths[pieces].reshape(-1, 2).sum(axis=1)
        place = numbered.indices.to_numpy()
        ids = gather(runs, np.cumsum(size) - size, size, place)
        upto = np.concatenate([[0], np.cumsum(size[place])])
        bounds = cut.offsets.to_numpy()
        return ids, upto[bounds[1:] - bounds[0]]


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> bytes:
    """The file of one shard. offsets: where each document starts, and the end; known: which documents have an id, all by default."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    width = max(1, int(ids.max(initial=0)).bit_length())
    cur = ids.astype(np.uint16 if width <= 16 else np.uint32)
    body, at, planes = [], 0, []

    def put(data: bytes) -> list[int]:
        nonlocal at
        small = squeeze(data)
        body.append(small)
        at += len(small)
        return [at - len(small), len(small)]

    sections = {"doc_ids": put(np.asarray(doc_ids, "<i8").tobytes()), "offsets": put(np.asarray(offsets, "<i8").tobytes())}
    sections["known"] = put(np.packbits(np.ones(len(doc_ids), bool) if known is None else known).tobytes())
    for shift in range(width - 1, -1, -1):
        ones = ((cur >> shift) & 1).astype(bool)
        packed = np.packbits(ones)
        starts = range(0, len(ids), BLOCK_BITS)
        before = np.cumsum([0, *(int(np.count_nonzero(ones[s : s + BLOCK_BITS])) for s in starts)])
        planes.append({"blocks": [put(packed[s // 8 : (s + BLOCK_BITS) // 8].tobytes()) for s in starts], "ones": before.tolist()})
        cur = np.concatenate([cur[~ones], cur[ones]])
    head = squeeze(json.dumps({"n": len(ids), "width": width, "sections": sections, "planes": planes}).encode())
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


class Shard:
    """Reads one shard file; data is its bytes or a file open for reading."""

    def __init__(self, data):
        self.data = data if hasattr(data, "read") else pa.BufferReader(data)
        self.open = zstandard.ZstdDecompressor().decompress
        self.data.seek(0)
        if self.data.read(4) != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(self.data.read(4), "little")
        self.head = json.loads(self.open(self.data.read(size)))
        self.base, self.n, self.width, self.planes = 8 + size, self.head["n"], self.head["width"], self.head["planes"]

    def _get(self, place: list[int]) -> bytes:
        self.data.seek(self.base + place[0])
        return self.open(self.data.read(place[1]))

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._get(self.head["sections"]["doc_ids"]), "<i8")

    def known(self) -> np.ndarray:
        """Which documents have an id."""
        return np.unpackbits(np.frombuffer(self._get(self.head["sections"]["known"]), np.uint8))[: len(self.doc_ids())].astype(bool)

    def offsets(self) -> np.ndarray:
        return np.frombuffer(self._get(self.head["sections"]["offsets"]), "<i8")

    def _bits(self, plane: int, block: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(self._get(self.planes[plane]["blocks"][block]), np.uint8))
        return bits[: min(BLOCK_BITS, self.n - block * BLOCK_BITS)]

    def _zeros(self, plane: int) -> int:
        return self.n - self.planes[plane]["ones"][-1]

    def _ones_before(self, plane: int, at: int) -> int:
        block, rest = divmod(at, BLOCK_BITS)
        return self.planes[plane]["ones"][block] + (int(np.count_nonzero(self._bits(plane, block)[:rest])) if rest else 0)

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.width):
            bit = int(self._bits(plane, at // BLOCK_BITS)[at % BLOCK_BITS])
            ones = self._ones_before(plane, at)
            value, at = value << 1 | bit, self._zeros(plane) + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's run starts in the bottom order, and where its first `end` positions stop."""
        low, high = 0, min(end, self.n)
        if value >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            low, high = (self._zeros(plane) + a, self._zeros(plane) + b) if value >> (self.width - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, end: int) -> int:
        """How often the id stands before position end."""
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _places(self, plane: int, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0, ascending) bits of that kind in a plane; each block is read once."""
        ones = np.asarray(self.planes[plane]["ones"])
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = b * BLOCK_BITS + np.flatnonzero(self._bits(plane, b) == bit)[k[here] - before[b]]
        return out

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """From places in the bottom order to positions."""
        for plane in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - plane) & 1
            at = self._places(plane, at - self._zeros(plane) if bit else at, bit)
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of the id."""
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        return int(self._up(value, np.array([low + k]))[0])

    def find(self, value: int) -> list[int]:
        """All positions of the id."""
        return self._up(value, np.arange(*self._range(value, self.n))).tolist()

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        value = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for plane in range(self.width - 1, -1, -1):
            blocks = [self._bits(plane, b) for b in range(len(self.planes[plane]["blocks"]))]
            ones = np.concatenate(blocks).astype(bool) if blocks else np.zeros(0, bool)
            above, zeros = np.empty_like(value), self._zeros(plane)
            above[~ones] = value[:zeros]
            above[ones] = value[zeros:] | (1 << (self.width - 1 - plane))
            value = above
        return value


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode the whole texts and write the shard files below folder (a URI that executors and driver
    share; the default is a scratch folder). Returns the manifest, one row per shard in order of doc_id:
    part, seq, path, n_docs, n_tokens, and start, the tokens of all shards before it.

    Null texts count as empty and hold end_id only. Rows without doc_id come first, and equal doc_ids
    follow each other in the order of their texts' hashes; both are written. A text longer than a shard is a shard of its own.
    An empty table has no shard. Extra columns are left out.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark) + "-shards"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), word_encoder(tokenizer)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> None:
            nonlocal size
            name = f"{base}/shard-{task.partitionId():06d}-{len(done):05d}-{task.taskAttemptId()}.twm"
            ids, sizes, doc_ids, known = map(np.concatenate, zip(*held, strict=True))
            with store.open_output_stream(name) as out:
                out.write(pack(ids, doc_ids, np.concatenate([[0], np.cumsum(sizes)]), known))
            done.append((task.partitionId(), len(done), name, len(doc_ids), size))
            held.clear()
            size = 0

        for part in batch_slices(batches, "_text"):
            ids, ends = encoder.encode(part.column("_text"))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0)
            column = part.column("doc_id")
            doc_ids, known = pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(ends):
                # As many documents as the open shard takes; one at least if it is empty.
                begun = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, begun + SHARD_TOKENS - size, "right"))
                if stop <= start:
                    if held:
                        close()
                        continue
                    stop = start + 1
                held.append((ids[begun : ends[stop - 1]], sizes[start:stop], doc_ids[start:stop], known[start:stop]))
                size += int(ends[stop - 1]) - begun
                start = stop
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["part", "seq", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_tie"), F.col("text").cast("string").alias("_text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "_text")
    manifest = save(ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"))
    before = lambda w: F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", F.coalesce(before(Window.orderBy("part")), F.lit(0)).alias("_base"))
    inner = F.coalesce(before(Window.partitionBy("part").orderBy("seq")), F.lit(0))
    return manifest.withColumn("_inner", inner).join(parts, "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("_base") + F.col("_inner")).alias("start"), F.lit(folder).alias("folder"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                store, _ = fs.FileSystem.from_uri(row.folder)
                with store.open_input_file(row.path) as data:
                    shard = Shard(data)
                    ids, at, doc_ids, known = memoryview(shard.ids().astype("<u4").tobytes()), shard.offsets(), shard.doc_ids(), shard.known()
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(doc_ids.astype(np.int64), ~known),
                    "start": row.start + at[:-1],
                    "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                })

    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "part", "seq")
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Per shard that holds the token: path and its positions in the whole corpus, looked up without decoding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                store, _ = fs.FileSystem.from_uri(row.folder)
                with store.open_input_file(row.path) as data:
                    found = Shard(data).find(token)
                if found:
                    yield pd.DataFrame({"path": row.path, "position": [row.start + p for p in found]})

    return manifest.mapInPandas(run, "path string, position long")
