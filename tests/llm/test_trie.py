import hashlib
import random
import re
import zlib
from collections import defaultdict

from tidemark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, block long"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1] or 0, t[2:]))] for c, x in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:] if rebuild else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def rows_of(found):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


def conversations():
    rng = random.Random(5)
    texts = ["a b c", "hello", "", None, "x  y\tz", "same words again"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), "n", 1) for c in range(90) if c not in (40, 41) for t in range(rng.choice([0, 1, 2, 3, 6]))]
    rows += [(c, t, "user", f"copy {t}", "n", 1) for c in range(200, 320) for t in range(3)]  # one very common conversation
    rows += [(c, t, "user", f"deep {t} or so", "n", 1) for c in (500, 501) for t in range(60)]
    rows += [(700, None, "user", "first", "n", 1), (700, 2, "b", "tie", "n", 1), (700, 2, "a", "tie", "n", 1), (700, 2, "a", "tie", "n", 1), (None, 1, "user", "nobody", "n", 1)]
    rows += [(1043, 0, "user", "alone", "n", 1), (65_600, 0, "user", "copy 0", "n", 1), (800, 0, "user", "long " * 100_000, "n", 1)]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA)
    want = brute(rows)
    assert rows_of(trie.trie(trie.rebuilt_sequences(df))) == want
    assert rows_of(trie.trie(trie.sequences(df))) == brute(rows, rebuild=False)
    assert any(n == 65 and end == hashlib.sha256(b"").hexdigest() for _, d, _, n, *_, end in want if d) or len(want) > 100
    # Small tables, several rounds of merges, and ends in many blocks.
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "MOST_HELD", 7)
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    assert rows_of(trie.trie(trie.rebuilt_sequences(df.repartition(6)))) == want


def test_empty_and_lone(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    assert trie.trie(trie.rebuilt_sequences(df.limit(0))).count() == 0
    assert trie.trie(trie.rebuilt_sequences(df.filter("conv_id is null"))).count() == 0
    # 1043 drops its only turn (its h is above 0) and has no conversation 1040 to inherit from: it ends at the root.
    h = zlib.crc32(b"1043") % 4
    (root, *rest) = sorted(trie.trie(trie.rebuilt_sequences(df.filter("conv_id = 1043"))).collect(), key=lambda r: r.depth)
    assert root.depth == 0 and root.parent_conv_id is None and root.n_convs == 1 and len(rest) == (h == 0)
    if h:
        assert root.ends_sha256 == hashlib.sha256(b"1043").hexdigest() and root.n_leaves == 1
