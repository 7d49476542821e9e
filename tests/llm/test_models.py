import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import langid, mixing, quality
from tidemark.llm.queries import MIXING_SQL

SF = "/root/testdata/sf0.001"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def brute_more(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    longest = max((len(w.encode()) for w in words), default=0)
    return lines, len(set(words)), len(re.findall(r"[.,;:!?()'\"-]", text)), len(re.findall("[0-9]", text)), len(re.findall("[A-Z]", text)), longest


def brute_features(text):
    """The features by their names, from the brute-force counts."""
    words, chars, symbols, dup, repeat = brute_counts(text)
    lines, distinct, punctuation, digits, upper, longest = brute_more(text)
    w, c = max(words, 1), max(chars, 1)
    ratios = {"word_length": chars / w, "symbol_share": symbols / c, "dup_lines_per_word": dup / w, "repeat_share": repeat / w, "words_per_line": words / max(lines, 1)}
    return {"words": words, **ratios, "distinct_share": distinct / w, "punctuation_share": punctuation / c, "digit_share": digits / c, "upper_share": upper / c, "longest_word": longest}


def brute_rule(rules, text):
    """The number of the first rule whose every condition holds."""
    x = brute_features(text)
    return next((i + 1 for i, r in enumerate(rules) if all((x[n] > at) if above else (x[n] <= at) for n, above, at in r.literals)), None)


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n \n ", "é日 #\x1c# é日", "a\x0bb\x85c d"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert quality.count(t)[:5] == brute_counts(t), t
        assert quality.count(t)[5:] == brute_more(t), t


def test_decision_list_learns_and_applies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(out) == docs.count()
    rules = quality.learn(quality.statistics(docs), quality.sample_of(labels))
    assert rules
    for r in docs.collect():
        got = out[r.doc_id]
        want = brute_counts(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got.rule == (None if got.base_failed else brute_rule(rules, r.text))
        assert got.kept == (not got.base_failed and got.rule is None)
    kept = quality.keep_documents(docs.withColumn("n_words", docs["lang"]), labels)
    assert kept.columns == [*docs.columns, "n_words"]
    assert {r.doc_id for r in kept.collect()} == {k for k, r in out.items() if r.kept}
    none = spark.createDataFrame([], docs.schema)
    assert quality.judge(none, labels).count() == 0 and quality.keep_documents(none, labels).count() == 0


def test_sequential_covering():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.7))
    rules = quality.cover(x, bad)
    hit = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * hit.sum()
    assert len(rules) >= 2 and max(len(r.literals) for r in rules) >= 2
    assert quality.cover(x, np.zeros(3000, bool)) == []


def test_rules_on_rows_that_taught_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id % 3 = 0").collect()}
    out = [(r.rule is not None, truth[r.doc_id] == 0) for r in quality.judge(docs, labels.filter("doc_id % 3 <> 0")).collect() if r.doc_id in truth and not r.base_failed]
    right = sum(a and b for a, b in out)
    assert right >= 0.9 * sum(a for a, _ in out) and right >= 0.7 * sum(b for _, b in out), (right, sum(a for a, _ in out), sum(b for _, b in out))


def test_odd_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, "n"), (2, "x# y# " * 9000, "n"), (2, "x# y# " * 9000, "n"), (None, "q w e " * 30, "n"), (4, None, None)], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 0), (None, 0), (77, 0)], "doc_id long, quality int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == 5 and sorted(r.n_words for r in out) == [0, 90, 120, 18000, 18000]
    assert [r.base_failed for r in out if r.doc_id == 4] == [True]
    assert all(len(quality.judge(docs, t).collect()) == 5 for t in (labels.limit(0), labels.filter("quality is null")))
    assert quality.keep_documents(docs, labels.limit(0)).columns == docs.columns


def test_mixing_equals_sql_and_sort(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(1, "w w", "hot")] * 300 + [(None, None, "s1"), (None, "", None), (7, "x " * 9000, "s2"), (9, "one", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(mixing.mix(docs).collect(), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(MIXING_SQL.strip()).fetchall()
    key = lambda r: str((r[0], r[1], r[2], round(r[3], 3), r[4]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sum({(r.source_size, r.target): r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    assert all(r.taken <= 3 * r.size for r in got)
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs.withColumn("_u", docs.source)).collect())
    taken = defaultdict(int)
    for r in got:
        taken[r.doc_id] += r.taken
    for (d, t), n in copies.items():
        if d not in (1, 7, 9) and d is not None and t.strip():
            assert n * len(t.split()) == taken[d]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    right = n = 0
    for r in docs.collect():
        assert out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if out[r.doc_id].held_out and r.lang:
            n += 1
            right += out[r.doc_id].lang_pred == r.lang
    assert right >= 0.97 * n, right / n


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (4, "123 !?", "en"), (5, "hello world", "en"), (None, "hallo welt", "de"), (5, "hello world", None)], "doc_id long, text string, lang string")
    out = langid.identify(docs).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in out if r.doc_id in (1, 2, 4)] == ["und"] * 3
    assert langid.identify(docs.limit(0)).count() == 0
    assert all(r.lang_pred == "und" for r in langid.identify(docs.filter("lang is null")).collect())
    for k in (1, 2, 3, 6, 7, 40):
        code = langid.codewords(k)
        assert len({tuple(c) for c in code}) == k
