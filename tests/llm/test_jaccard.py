import random
import re

from tests.llm.test_neardup_urls import closure
from tidemark.llm import jaccard


def brute(rows, width=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                links.append((j, i))
    root = closure(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    return [(d, len(s), least[root[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(rng):
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, docs = text(40), []
    for _ in range(60):
        base = text(rng.choice([3, 5, 8, 30, 120]))
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            docs.append(copy)
    hot = text(100)
    for k in range(80):
        copy = list(hot)
        copy[k] = "x"
        if k % 2:
            copy[(k * 7) % 100] = f"y{k}"
        docs.append(copy)
    line = text(30)
    for k in range(50):  # all share much, none enough
        docs.append([f"z{k}" if i in (k % 29, (k * 11 + 5) % 30) else w for i, w in enumerate(line)])
    docs += [passage + text(rng.choice([1, 3, 6, 9])) for _ in range(60)]
    texts = [" ".join(d) for d in docs] + [None, "", " \n", "a", "A", "a b c", "a\tB c", "É x y z", "é x y z", "w1 " * 500, "w1 " * 700]
    rng.shuffle(texts)
    return texts


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LIST", 20)
    for seed in (1,):
        texts = corpus(random.Random(seed))
        rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(7, texts[1]), (7, texts[1])]
        df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(5)
        got = [tuple(r) for r in jaccard.join_components(df).collect()]
        want = brute(rows)
        assert sorted(got) == sorted(want)
        kept = [r.doc_id for r in jaccard.keep_documents(df).collect()]
        empty = [d for d, n, _ in want if not n]
        assert sorted(kept) == sorted({c for _, n, c in want if n} | set(empty))
    assert jaccard.join_components(df.limit(0)).count() == 0 and jaccard.keep_documents(df.limit(0)).count() == 0


def test_adaptive_prefixes():
    import numpy as np

    # 100 shingles, all shared: 16 are the least, and each more asks for one more match.
    assert jaccard.length(100, np.full(100, 3), 85) == 100 - 85 + jaccard.MOST_MATCHES
    assert jaccard.length(100, np.array([3] * 16 + [10**6] * 84), 85) == 16
    assert jaccard.length(10, np.full(10, 3), 85) == 2
    # Shingles that no other set holds are part of the prefix and not in any list.
    assert jaccard.length(100, np.array([3] * 4 + [10**6] * 84), 85) == 4


def test_shared_shingles_are_counted_exactly(spark, monkeypatch):
    texts = corpus(random.Random(5))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:40])], "doc_id long, _text string").repartition(6)
    sets = {jaccard.node_of(s): s for s in jaccard.shingle_sets(texts, 4) if len(s)}
    holders = {}
    for node, found in sets.items():
        for x in found.tolist():
            holders.setdefault(x, set()).add(node)
    want = sorted((node, sum(len(holders[x]) > 1 for x in found.tolist())) for node, found in sets.items())
    _, sketch = jaccard.census(df, 4)
    for least in (1 << 13, 20):  # with 20 some shingles count as very frequent
        monkeypatch.setattr(jaccard, "FREQUENT", least)
        monkeypatch.setattr(jaccard, "ABOVE_NOISE", 0)
        found = jaccard.shared_shingles(df.select("_text"), sketch, 7, 4)
        got = {r.node: r["count"] for r in found.groupBy("node").count().collect()}
        assert sorted((node, got.get(node, 0)) for node in sets) == want
        exact = {(len(h), node) for h in holders.values() if 1 < len(h) < 20 for node in h}
        assert exact <= {(r.df, r.node) for r in found.collect()}


def test_sets_do_not_depend_on_grouping():
    rng = random.Random(3)
    texts = corpus(rng) + ["x " * 90_000, "A b\x0bc\x85d \x1c"]
    together = jaccard.shingle_sets(texts, 4)
    assert all((a == jaccard.shingles(t, 4)).all() for a, t in zip(together, texts, strict=True))
    assert [len(s) for s in together] == [n for _, n, _ in brute(list(enumerate(texts)))]
