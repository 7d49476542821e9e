"""The pipeline against brute force, stage by stage on what each stage kept."""

import re
from collections import Counter

import public_tokenizers  # noqa: F401
import sentencepiece

import corpus_pipeline
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_lines import brute as without_lines
from tests.llm.test_models import brute_counts, brute_rule
from tidemark.llm import quality
from tidemark.llm.queries import PIECES

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF).collect()
    stats = {r.doc_id: (brute_counts(r.text), r.text) for r in docs.collect()}
    rules = quality.learn(quality.statistics(docs), quality.sample_of(labels))
    want = {d for d, (c, t) in stats.items() if not (c[0] < 50 or 100 * c[4] > 50 * c[0]) and brute_rule(rules, t) is None}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)

    df = spark.createDataFrame(kept, docs.schema)
    cleaned = stages["line_dedup"](spark, df, SF).collect()
    assert {(r.doc_id, r.text) for r in cleaned} == {(d, t) for d, _, _, t in without_lines([(r.doc_id, r.text) for r in kept])}
    assert cleaned[0].__fields__ == docs.columns

    df = spark.createDataFrame(cleaned, docs.schema)
    single = stages["ngram_jaccard"](spark, df, SF).collect()
    groups = near_groups([(r.doc_id, r.text) for r in cleaned], width=5, percent=80)
    assert {r.doc_id for r in single} == {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}

    df = spark.createDataFrame(single, docs.schema)
    mixed = stages["source_mixing"](spark, df, SF).collect()
    sizes = Counter()
    taken = Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in single:
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    level, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * w) for s, w in weight.items()) < level else (low, mid)
    longest = {s: max(words(r.text) for r in single if r.source == s) for s in sizes}
    assert all(abs(taken[s] - min(3 * sizes[s], high * w)) <= longest[s] for s, w in weight.items())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = stages["sentencepiece_encode"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    texts = {r.doc_id: r.text for r in mixed}
    assert len(ids) == len(mixed) and all(list(r.ids) == lib.encode(texts[r.doc_id]) for r in ids)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
