"""Language identification with error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over hashed byte n-grams, whose weights
are the smoothed log odds of the n-grams in the languages coded 1 against those coded 0. A text's
margins are decoded by a weighted loss against every codeword. Training counts n-grams of all labelled
documents (no sample): one pass, and languages x BUCKETS sums, which is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
#: Odd multipliers of the rolling hash, one for each place of an n-gram.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: n-grams after which more text no longer sharpens the margins.
SATURATION = 400
#: A text is ambiguous when its two best languages score nearer than this.
AMBIGUOUS = 0.2


def buckets(text: str) -> np.ndarray:
    """The buckets of all byte n-grams of the whole text in lower case, white space as one space."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = []
    for n in SIZES:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h ^= raw[k : len(raw) - n + 1 + k] * np.uint32(_MIX[k])
                h *= np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def ngram_counts(docs: DataFrame, label: str) -> DataFrame:
    """_lang, bucket, n over all rows; each task sends at most languages x BUCKETS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in text_slices(batches, "_text"):
            for lang, text in zip(part.column("_lang").to_pylist(), texts, strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(buckets(text), minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["_lang", "bucket", "n"])

    rows = docs.select(F.col(label).cast("string").alias("_lang"), F.col("text").cast("string").alias("_text")).filter("_lang is not null and _text is not null")
    return rows.mapInArrow(run, "_lang string, bucket long, n long").groupBy("_lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of -1/1: all splits of the languages up to 6, else the best of 64 seeded random codes."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        splits = range((1 << (k - 1)) - 1)
        return np.array([[1, *(1 if s >> r & 1 else -1 for r in range(k - 1))] for s in splits], np.int8).T
    rng, best = np.random.default_rng(7), (-1, None)
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (k, 8 + 4 * int(np.ceil(np.log2(k)))))
        code = code[:, np.abs(code.sum(0, dtype=int)) < k]
        apart = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(k - 1))
        if apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of n-gram counts: the best language's index, its score, and the next best score."""
        n = np.maximum(counts.sum(1, keepdims=True), 1)
        margins = counts @ self.weights / n * np.minimum(n, SATURATION) ** 0.5
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.bit_weights).sum(2)
        near = np.exp(loss.min(1, keepdims=True) - loss)
        near /= near.sum(1, keepdims=True)
        best = near.argmax(1)
        top = np.sort(near, 1)
        return best, top[:, -1], top[:, -2] if near.shape[1] > 1 else np.zeros(len(best))


def fit(counted: DataFrame) -> Model | None:
    """The classifiers of all bits from counts by language and bucket; None without any language."""
    got = counted.toPandas()
    if got.empty:
        return None
    langs = tuple(sorted(got["_lang"].unique()))
    table = np.zeros((len(langs), BUCKETS))
    table[got["_lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    share = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        if (code[:, b] == 1).all():
            continue
        weights[:, b] = np.log(share[code[:, b] == 1].mean(0)) - np.log(share[code[:, b] == -1].mean(0))
    # A bit counts by how far it keeps the nearest language from the wrong side.
    apart = np.maximum((share @ weights * code).min(0), 1e-3)
    return Model(langs, code, weights.astype(np.float32), apart / apart.sum() * len(apart))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score in 0..1 and ambiguous. Texts that are null or hold no letter are
    `und` with score 0, as are all without a model. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part, texts in text_slices(batches, "_text"):
            langs, scores, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            real = [i for i, t in enumerate(texts) if known and t and any(map(str.isalpha, t))]
            for start in range(0, len(real), 256):
                some = real[start : start + 256]
                counts = np.stack([np.bincount(buckets(texts[i]), minlength=BUCKETS) for i in some]).astype(np.float32)
                for i, best, score, next_score in zip(some, *known.decode(counts), strict=True):
                    langs[i], scores[i], doubt[i] = known.langs[best], min(1.0, float(score)), score - next_score < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(scores), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict for all: doc_id, held_out, lang_pred,
    score, ambiguous. Repeated rows are predicted each; an empty table gives an empty table."""
    model = fit(ngram_counts(docs.filter(~held_out()), "lang"))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
