"""Quality rules: a learned decision list over text statistics.

Statistics are computed once per document over the whole text. Sequential covering learns, from
labelled documents, an ordered list of threshold conjunctions that reject: a rule is grown literal by
literal by information gain on two thirds of the labelled rows, pruned on the last third, and the rows it
covers are taken away. A rule that is not precise enough, or rejects too few rows, on the last third is not used; its
rows are taken away too, so that the list goes on. Thresholds lie half-way between neighbouring values, so what
differs little from clean rows stays. The list becomes one ordered Spark conditional
expression over the statistics, so applying it needs no Python.

Training reads a sample of at most about MAX_TRAINING labelled rows (the only bound on what is read): those with the
lowest hashes of doc_id. MAX_RULES and MAX_LITERALS bound how long and how specific the list gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACES, drop_saved, save, text_slices

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?()'\"-"
MAX_TRAINING = 50_000
#: A rule must reject so precisely, and cover so large a share of the rejected rows of the pruning third; tries end after MAX_RULES rules.
MIN_PRECISION, MIN_SHARE, MAX_RULES, MAX_LITERALS = 0.97, 0.005, 12, 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that only the learned rules read.
MORE = ("n_lines", "n_distinct_words", "n_punctuation", "n_digits", "n_upper", "longest_word")
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((PUNCTUATION, "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k + 1


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one whole text; null has none of anything. Digits, punctuation and upper case are the ASCII
    ones, and the longest word goes by bytes."""
    if not text:
        return (0,) * (len(COUNTS) + len(MORE))
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=4)[1:].tolist()
    own = (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words))
    return (*own, len(lines), len(set(words)), *classes, max(map(len, words), default=0))


def repeated(words: list[bytes]) -> int:
    """Words within 3-word windows that are found twice or more."""
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(ids) < 4 or len(number) > len(ids) - 1:
        return 0
    a = np.array(ids, np.int64)
    pairs = a[:-1] * len(number) + a[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + a[2:]
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    again, covered = times[place] > 1, np.zeros(len(a), bool)
    for k in range(3):
        covered[k : len(a) - 2 + k] |= again
    return int(covered.sum())


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, COUNTS and MORE, as longs."""
    source = docs.select(*(docs[c] for c in keep), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, *(T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text"):
            found = zip(*map(count, texts), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in found)], [*keep, *COUNTS, *MORE])

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that do not depend on a text's length, and its length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "distinct_share": F.col("n_distinct_words") / words,
        "punctuation_share": F.col("n_punctuation") / chars,
        "digit_share": F.col("n_digits") / chars,
        "upper_share": F.col("n_upper") / chars,
        "longest_word": F.col("longest_word").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, above?, threshold) holds."""

    literals: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.literals:
            out &= x[name] > at if above else x[name] <= at
        return out

    def column(self) -> Column:
        made, out = features(), F.lit(True)
        for name, above, at in self.literals:
            out = out & (made[name] > at if above else made[name] <= at)
        return out


def _cuts(v: np.ndarray) -> np.ndarray:
    """Thresholds half-way between neighbouring values of about 99 quantiles."""
    values = np.unique(np.quantile(v, np.linspace(0, 1, 101), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule, inside = Rule(()), np.ones(len(bad), bool)
    while len(rule.literals) < MAX_LITERALS and (inside & ~bad).any():
        p0, n0, best = (inside & bad).sum(), inside.sum(), (1e-9, None)
        for name, v in x.items():
            for at in _cuts(v[inside]):
                for above in (True, False):
                    hit = inside & ((v > at) if above else (v <= at))
                    p, n = (hit & bad).sum(), hit.sum()
                    if p and (gain := p * (np.log2(p / n) - np.log2(p0 / n0))) > best[0]:
                        best = (gain, (name, above, float(at)))
        if best[1] is None:
            break
        rule = Rule((*rule.literals, best[1]))
        inside = rule.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / max(1, p + n)

    return max((Rule(rule.literals[:k]) for k in range(len(rule.literals), 0, -1)), key=worth, default=rule)


def cover(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The decision list for labelled rows; deterministic for rows in a fixed order."""
    rules, third = [], np.arange(len(bad)) % 3 == 2
    goal = max(1, bad[third].sum())
    for _ in range(MAX_RULES):
        if not (bad[~third].any() and bad[third].any()):
            break
        take = lambda m: {k: v[m] for k, v in x.items()}  # noqa: B023, E731
        rule = _prune(_grow(take(~third), bad[~third]), take(third), bad[third])
        if not rule.literals:
            break
        hit = rule.covers(x)
        p, n = (hit & bad & third).sum(), (hit & third).sum()
        if n and p >= MIN_PRECISION * n and p >= MIN_SHARE * goal:
            rules.append(rule)
            drop = hit
        else:
            drop = hit & bad
        if not drop.any():
            break
        x, bad, third = take(~drop), bad[~drop], third[~drop]
    return rules


def sample_of(labels: DataFrame, max_training: int = MAX_TRAINING) -> DataFrame:
    """_id and _q (quality) of at most about max_training labelled rows."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).filter("_id is not null and _q is not null")
    share = max_training / max(1, known.count())
    place = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1_000_000
    return known.filter(place < share) if share < 1 else known


def learn(stats: DataFrame, sample: DataFrame) -> list[Rule]:
    """Rules from statistics joined with sample_of the labels (quality 0 is bad). Rows without a label
    or without statistics teach nothing; repeated labels count each. No labels or no bad ones: no rules."""
    made = features()
    # The sample is bounded by max_training, so it is broadcast.
    rows = stats.join(F.broadcast(sample), stats["doc_id"] == sample["_id"]).filter(~base_failed()).select("_id", (F.col("_q") == 0).alias("_bad"), *(c.alias(f"_{k}") for k, c in made.items()))
    got = rows.toPandas().sort_values(["_id", "_bad"], kind="stable")
    return cover({k: got[f"_{k}"].to_numpy(float) for k in made}, got["_bad"].to_numpy(bool)) if len(got) else []


def rule_of(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number (from 1) of the first rule that rejects, or null."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(rule.column(), i + 1) if out is None else out.when(rule.column(), i + 1)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, COUNTS, base_failed, kept, and rule, the number of the learned rule that rejects it.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each, texts of any length whole; a row
    without doc_id is judged too. An empty table gives an empty table; extra columns are left out.
    """
    stats = save(statistics(docs))
    rules = learn(stats, sample_of(labels))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~base_failed(), rule_of(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*MORE)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rule and the learned list keep, with all their columns, whatever their names."""
    columns = tuple(docs.columns)
    sample = sample_of(labels)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    training = save(statistics(labelled))
    rules = learn(training, sample)
    drop_saved(training)
    # Each row travels as one struct beside its counts, so no name clashes and no join by document is needed.
    rows = statistics(docs.select(F.struct(*(docs[c] for c in columns)).alias("_in"), docs["text"]), ("_in",))
    return rows.filter(~base_failed() & rule_of(rules).isNull()).select(*(F.col(f"_in.{c}").alias(c) for c in columns))
