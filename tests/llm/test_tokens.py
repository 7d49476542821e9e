import hashlib
import random
import uuid
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import pieces, wavelet
from tidemark.llm.queries import PIECES, WORDS

ODD = ["", " ", "  a", "a ", "▁x ▁", "é é ﬁ", "\x00\t\r\n", "日本語 テスト", "Étion's don't I'LL", "x" * 3000, "<|endoftext|> a<|startoftext|>b", "İstanbul ßÜ", "a b　c", "12 345,6!? it's...", "ŉ Ω ̸ ̸a", "<s></s><unk>"]


def texts(n=300):
    rng = random.Random(5)
    alphabet = "abcde  \n\tÉßçñ.,'▁́ 日😀<|>09ΣİA"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_equal_library(spark, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pieces, "PAGE_BYTES", 1000)
    rows = [(i, t) for i, t in enumerate(texts())] + [(-1, None), (None, "a b"), (0, ""), (7, "x  y " * 30_000), (7, "x  y " * 30_000), (8, " ")]
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(pieces, "GATHERED", 40)
    want = sorted(((d, lib.encode(t or "")) for d, t in rows), key=str)
    out = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES), PIECES).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in out), key=str) == want
    for r in out:
        assert r.decoded == (lib.decode(r.ids) if r.ids else "")
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string, ids int, decoded int"), PIECES).count() == 0


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(1, None)], [(i, "a b" if i == 9 else ("" if i % 2 else None)) for i in range(12)]])
def test_pieces_of_pages_without_a_chunk(spark, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    nothing = hashlib.sha256(b"").hexdigest()
    for parts in (1, 4):
        got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts), PIECES).collect()}
        assert {d: r.n_tokens for d, r in got.items()} == {d: len(lib.encode(t or "")) for d, t in rows}
        assert all(r.ids_sha256 == r.decoded_sha256 == nothing for r in got.values() if not r.n_tokens)


def test_pieces_of_a_page_are_cut_in_parts(monkeypatch):
    held = []

    def logged(some):
        held.append(sum(len((t or "").encode()) for t in some.to_pylist()))
        return own(some)

    own = pieces.chunks_of
    monkeypatch.setattr(pieces, "chunks_of", logged)
    monkeypatch.setattr(pieces, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    rows = [None, "", *(" ".join(f"w{i * j % 9973}" for j in range(500)) for i in range(2000)), *texts(), None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["_text"])
    (page,) = pieces._numbered(iter([batch]), 7)
    _, _, part, counts, codes, chunks, bucket = page
    assert sum(held) > 4 << 20 and max(held) <= pieces.PAGE_BYTES // 8 and part.num_rows == len(rows)
    whole, n = own(batch.column("_text"))
    assert chunks.take(pa.array(codes)).equals(whole) and counts.tolist() == n.tolist()
    assert len(chunks) == len(set(chunks.to_pylist())) == len(bucket) and bucket.max() < 7


def test_pieces_segment_each_chunk_once(spark, monkeypatch, tmp_path):
    def logged(chunks, model):
        with open(tmp_path / uuid.uuid4().hex, "w") as f:
            f.write("".join(c + "\n" for c in chunks))
        return own(chunks, model)

    own = pieces.segmented
    monkeypatch.setattr(pieces, "segmented", logged)
    monkeypatch.setattr(pieces, "PAGE_BYTES", 200)
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 2000)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(20))) for i in range(400)]
    assert pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id"), PIECES).count() == 400
    seen = [c for f in tmp_path.iterdir() for c in f.read_text().splitlines()]
    assert sorted(seen) == sorted({" " + w for _, t in rows for w in t.split()})


def test_pieces_refuse_rows_that_change(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.uuid().alias("text"))
    docs = docs.withColumn("text", F.udf(lambda x: uuid.uuid4().hex)("text"))
    with pytest.raises(Exception, match="read again"):
        pieces.encode(docs, PIECES).collect()


def test_words_equal_library():
    lib = Tokenizer.from_file(WORDS)
    enc = wavelet.WordEncoder(WORDS)
    some = [*texts(2000), None, "x y " * 40_000]
    ids, ends = enc.encode(pa.array(["left out", *some]).slice(1))
    for t, g in zip(some, np.split(ids, ends[:-1]), strict=True):
        assert g.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_words_are_encoded_by_their_pieces(monkeypatch):
    """Forms of a word share its stem's entry, and the table starts anew without a change of ids."""
    enc = wavelet.WordEncoder(WORDS)
    forms = [w + m for w in ("stone", "Stone", "STONE", "Élan", "élan") for m in ("", ",", ".", "!?", ");")]
    enc.encode(pa.array([" ".join(forms)]))
    assert sorted(enc.known) == ["", "!?", ");", ",", ".", "stone", "élan"]
    monkeypatch.setattr(wavelet, "TABLE_WORDS", 50)
    lib, some = Tokenizer.from_file(WORDS), texts(500)
    got = []
    for i in range(0, len(some), 20):
        ids, ends = enc.encode(pa.array(some[i : i + 20]))
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_shard_lookups():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 200_000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.pack(ids, np.array([7, 8]), np.array([0, 5, len(ids)])))
    assert (shard.ids() == ids).all() and shard.doc_ids().tolist() == [7, 8]
    for at in (0, 65535, 65536, 131072, len(ids) - 1):
        assert shard.access(at) == ids[at]
    where = np.flatnonzero(ids == 33)
    assert shard.count(33) == len(where) and shard.count(63) == 0 and shard.count(64) == 0
    assert shard.rank(33, 100_000) == (where < 100_000).sum()
    assert shard.find(33) == where.tolist() and shard.find(63) == [] and shard.find(64) == []
    assert [shard.select(33, k) for k in (0, 1, len(where) - 1)] == where[[0, 1, -1]].tolist()
    with pytest.raises(IndexError):
        shard.select(33, len(where))
    empty = wavelet.Shard(wavelet.pack(np.zeros(0, np.uint32), np.zeros(0), np.zeros(1)))
    assert empty.ids().tolist() == [] and empty.count(0) == 0


def test_shards_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 100)
    lib = Tokenizer.from_file(WORDS)
    rows = [Row(doc_id=3 * i, text=t, start="clash") for i, t in enumerate(texts())] + [Row(doc_id=4, text=None, start=""), Row(doc_id=-(1 << 63), text="a b", start="")]
    manifest = wavelet.write_shards(spark.createDataFrame(rows), WORDS, 2)
    assert manifest.count() > 5
    got = {r.doc_id: r for r in wavelet.read_shards(manifest).collect()}
    start = 0
    every = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id].start == start and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        every += ids
    twice = spark.createDataFrame([(None, "a", 1), (None, "b c", 2), (5, "d", 3), (5, "d", 4), (5, "x " * 500, 5)], "doc_id long, text string, n_tokens int")
    again = wavelet.read_shards(wavelet.write_shards(twice, WORDS, 2)).collect()
    assert [r.doc_id for r in sorted(again, key=lambda r: r.start)] == [None, None, 5, 5, 5] and sorted(r.n_tokens for r in again)[:4] == [2, 2, 2, 3]
    found = sorted(r.position for r in wavelet.occurrences(manifest, 320).collect())
    assert found == [i for i, x in enumerate(every) if x == 320]
    assert wavelet.read_shards(wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), WORDS, 2)).count() == 0
