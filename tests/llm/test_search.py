import math
import random
import re
from collections import Counter

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    tallies = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_all, total = sum(1 for _, c in tallies if c), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, c in tallies:
            n = sum(c.values())
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * n_all // total))) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(str(item), i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É1", "été", "Ünï", "the", "The", "a-b", "x_y", "😀"]
    skew = [1 / (i + 1) for i in range(len(words))]
    rows = [(i * 3, " ".join(rng.choices(words, skew, k=rng.choice([0, 1, 5, 40, 200]))), "z") for i in range(n)]
    rows += [(5, rows[7][1], "z")] * 25 + [(None, "w1 w2 w250", "z"), (10_001, None, "z"), (10_002, "", "z"), (10_003, "w3 " * 200_000 + "w299", "z"), (10_004, "...", "z")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(25)] + [(100, None), (101, "?!"), (102, "unheard of"), (103, "w1 w1 w1 W2"), (103, "w1 w1 w1 W2"), (None, "w5")]
    return rows, items


def found_by(spark, rows, items, k, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted([(str(r.item_id), r.rank, r.doc_id, r.score) for r in search.search(docs, asked, k).collect()], key=str)


def test_equals_brute_force(spark, monkeypatch):
    rows, items = corpus(900)
    want = brute(rows, items, 20)
    assert found_by(spark, rows, items, 20) == want
    # Many small sets of treaps, small steps, several blocks of queries.
    monkeypatch.setattr(search, "TREAP_DOCS", 60)
    monkeypatch.setattr(search, "STEP_CELLS", 64)
    monkeypatch.setattr(search, "BLOCK_BYTES", 1500)
    assert found_by(spark, rows, items, 20, parts=3) == want


def test_treaps_prune_and_hold_their_order():
    rng = random.Random(6)
    keys = [rng.randrange(50) << 20 | i for i in range(500)]
    left, right, roots = search.children(keys, [0, 200, 201])
    for root, a, b in zip(roots, (0, 200, 201), (200, 201, 500)):
        seen, todo = [], [(root, a, b)]
        while todo:
            node, low, high = todo.pop()
            if node < 500:
                assert low <= node < high and keys[node] == max(keys[low:high])
                seen.append(node)
                todo += [(left[node], low, node), (right[node], node + 1, high)]
        assert sorted(seen) == list(range(a, b))


def test_edges(spark):
    rows, items = corpus(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(docs.limit(0), asked).count() == 0 and search.search(docs, asked.limit(0)).count() == 0
    assert search.search(docs.filter("text is null"), asked).count() == 0
    assert search.search(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]
    one = search.search(docs.filter("doc_id is null"), asked.filter("item_id = 103")).collect()
    assert [r.doc_id for r in one] == ([None, None] if one else [])
