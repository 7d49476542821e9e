import hashlib

from tidemark.llm import chat

ODD = ["", "a", "<|im_end|>\n<|im_start|>user\nhi", "\\", "\\\\<|", "<\\|", "\\<|x\\n", "é😀\n\n", "<|" * 5 + "\\|", None]


def brute_paths(rows):
    ids = {(c, m) for c, m, *_ in rows}
    up = {(c, m): p if p is not None and p < m and (c, p) in ids else None for c, m, p, *_ in rows}
    score = {(c, m): s or 0 for c, m, p, s, *_ in rows}
    parents = {(c, p) for (c, m), p in up.items() if p is not None}
    out = {}
    for c, m in ids - parents:
        path, at = [], m
        while at is not None:
            path.append(at)
            at = up[c, at]
        out[c, m] = (path[::-1], sum(score[c, x] for x in path))
    return out


def test_trees_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = []
    for c in [*range(12), None]:
        for m in range(rng.choice([1, 2, 9, 40])):
            rows.append((c, m, rng.choice([None, m - 1, rng.randrange(m + 1), m + 3]), rng.choice([None, 1.0, 2.0, -1.0]), rng.choice(["user", "assistant", "so\\n\nme", None]), rng.choice(ODD)))
    rows += [(99, m, m - 1, 1.0, "user", f"t{m}") for m in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, score double, role string, text string")
    want = brute_paths(rows)
    by_id = {(r[0], r[1]): r for r in rows}
    got = {(r.conv_id, r.leaf_id): r for r in chat.format_paths(df).select("*", chat.parse(chat.F.col("formatted")).alias("turns")).collect()}
    assert got.keys() == want.keys()
    for (c, leaf), r in got.items():
        path, score = want[c, leaf]
        assert r.branch_score == score
        assert [(t.role, t.text) for t in r.turns] == [(by_id[c, m][4] or "", by_id[c, m][5] or "") for m in path]
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert len(masked) == sum(by_id[c, m][4] == "assistant" for m in path)
    for r in got.values():
        starts = [0]
        for t in r.formatted.split(chat.START)[1:]:
            starts.append(starts[-1] + len(chat.START) + len(t))
        assert all(starts[s.turn] + s.skip == s.start for s in r.loss)
    best = chat.format_paths(df, branches=2).collect()
    ranked = {}
    for (c, leaf), (_, score) in want.items():
        ranked.setdefault(c, []).append((-score, leaf))
    assert {(r.conv_id, r.leaf_id, r.rank) for r in best} == {(c, leaf, i + 1) for c, x in ranked.items() for i, (_, leaf) in enumerate(sorted(x)[:2])}
    assert chat.format_paths(df.limit(0)).count() == 0


def test_chain_digests(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", ODD[(c + t) % len(ODD)], "x") for c in range(5) for t in range(c * 3)]
    rows += [(2, 1, "assistant", "tie", "x"), (None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg_id string")
    got = {r.conv_id: r for r in chat.digests(chat.format_paths(chat.as_chain(df))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        flat = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_repeated_messages_and_long_conversations(spark):
    again = [(1, 1, None, 0.0, "user", "a"), (1, 1, None, 0.0, "user", "a"), (1, 1, None, 0.0, "user", "b"), (1, 2, 1, 1.0, "assistant", "c"), (1, 2, 1, 1.0, "assistant", "c")]
    schema = "conv_id long, msg_id long, parent_id long, score double, role string, text string"
    (r,) = chat.format_paths(spark.createDataFrame(again, schema), branches=1).collect()
    assert r.formatted.count(chat.START) == 2 and "a" in r.formatted and r.rank == 1 and r.branch_score == 1.0
    n = 300
    rows = [(7, i, "assistant" if i % 2 else "user", f"é{i}" * 200) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.format_paths(chat.as_chain(df), branches=1)).collect()
    loss = "".join(t for _, i, _, t in rows if i % 2)
    assert r.n_turns == n and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
