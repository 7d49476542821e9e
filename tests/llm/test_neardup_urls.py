import importlib
import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import neardup, urlrules
from tidemark.llm.components import components
from tidemark.llm.queries import CHAT_SQL, op1_chat_format


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(3, 3), (-5, 7), (-5, 7), (7, -9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [5, 100, 250_000])
def test_components_with_and_without_steps(spark, monkeypatch, at_once):
    monkeypatch.setattr(importlib.import_module("tidemark.llm.components"), "TASK_EDGES", at_once)
    rng = np.random.default_rng(at_once)
    edges = [(i, i + 1) for i in range(40)] + [(900 + i, 999) for i in range(30)] + [(-3, 2**62), (2**62, -(2**62))] + rng.integers(2000, 2080, (60, 2)).tolist()
    real = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == closure({x for e in real for x in e}, real) and len(got) == len({x for e in real for x in e})


def test_few_edges_take_few_jobs(spark):
    """Every job costs the driver memory for a moment: a long path of few edges takes no round for each halving."""
    context = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    context.setJobGroup("few edges", "components")
    try:
        assert components(edges).count() == 201
        assert len(context.statusTracker().getJobIdsForGroup("few edges")) <= 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 24))
    hot = rng.standard_normal(24) + 0.1 * rng.standard_normal((150, 24))
    near = base[:60] + 0.3 * rng.standard_normal((60, 24))
    x = np.concatenate([base, hot, near, base[:5], base[:1], 3 * base[7:8]])
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)]
    rows += [(2000 + i, (v * 1e200).tolist(), "clash", 1) for i, v in enumerate(base[:3])]
    rows.append((None, base[9].tolist(), "clash", 1))
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, None, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, copies int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    # Rows 2000 to 2002 are the first three again, larger.
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    links = [(int(a), int(b)) for a, b in np.argwhere(hit)]
    degree = hit.sum(1) + hit[:, :3].sum(1)
    degree[:3] += 1
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.97 * degree.sum() <= found <= degree.sum()
    assert all(got[i].n_links <= degree[i] for i in range(len(x)))
    want = closure(range(len(x)), links)
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(x)
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(6))
    assert all(got[2000 + i].component_id == got[i].component_id and not got[2000 + i].kept for i in range(3))
    assert got[None].component_id == got[9].component_id
    assert got[1007].component_id == 1006 and not got[1007].kept
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def paired(n, dim=64):
    """Unit vectors 2k and 2k + 1 of cosine 0.9001, the last third in one cone (cosine 0.7 to each other), and the first row of the cone."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    cone = 2 * (n // 3)

    def pairs(k, width, cosine):
        a, b = unit(rng.standard_normal((k, width))), rng.standard_normal((k, width))
        b = unit(b - (b * a).sum(1, keepdims=True) * a)
        return np.stack([a, cosine * a + np.sqrt(1 - cosine * cosine) * b], 1).reshape(2 * k, width)

    thin = np.sqrt(0.3) * pairs((n - cone) // 2, dim - 1, (0.9001 - 0.7) / 0.3)
    return np.concatenate([pairs(cone // 2, dim, 0.9001), np.column_stack([np.full(len(thin), np.sqrt(0.7)), thin])]), cone


def test_embeddings_recall_in_dense_third(spark):
    x, cone = paired(20_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    _, one = neardup.classes(df)
    vec = {r.node: r.least for r in one.select("node", "least").collect()}
    found = {(vec[r.a], vec[r.b]) for r in neardup.window_links(one, 0.9).collect()}
    group = closure(range(len(x)), found)
    hit = np.array([group[i] == group[i + 1] for i in range(0, len(x), 2)])
    assert hit[: cone // 2].mean() >= 0.99 and hit[cone // 2 :].mean() >= 0.99


def test_embeddings_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 256)
    x, _ = paired(4_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (2, 150):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            _, one = neardup.classes(df.repartition(n))
            vec = {r.node: r.least for r in one.select("node", "least").collect()}
            got.append(closure(range(len(x)), [(vec[r.a], vec[r.b]) for r in neardup.window_links(one, 0.9).collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sum(got[0][i] != got[1][i] for i in got[0]) == 0


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls_equal_brute_force(spark):
    real = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").collect()]
    odd = [None, "", "x", "http://", "http://com/", "http://COM", "ftp://a.Net/es/x://y", "http://wwwexample.com/en/", "http://x.www.example.com/en/1", "http://example.com?x#/en/", "http://É.com/en", "a://b.net/fr"]
    rows = [(i, u, "h") for i, u in enumerate(real + odd + real[:20])]
    got = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    fixed = {}
    for i, u, _ in rows:
        host, path = split(u)
        best = max((r for r in urlrules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.name), default=None)
        fixed[i] = best
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name), u
        if best:
            assert got[i].verdict == best.verdict
    sets = urlrules.split_url(spark.createDataFrame(rows, "page_id long, url string, host string")).select("page_id", urlrules.tokens().alias("t")).collect()
    sets = {r.page_id: frozenset(r.t) for r in sets}
    labelled = [(sets[i], fixed[i].verdict) for i in sets if fixed[i]]
    both, alone = Counter(), Counter()
    for t, v in labelled:
        for n in range(1, len(t) + 1):
            for part in map(frozenset, itertools.combinations(sorted(t), n)):
                alone[part] += 1
                both[part, v] += 1
    need = int(np.ceil(urlrules.MIN_SUPPORT * len(labelled)))
    rules = {(p, v): (c / alone[p], c / len(labelled)) for (p, v), c in both.items() if c >= need and c / alone[p] >= urlrules.MIN_CONFIDENCE}
    kept = {k: m for k, m in rules.items() if not any((k[0] - {x}, k[1]) in rules and rules[k[0] - {x}, k[1]][0] >= m[0] for x in k[0])}
    by_token = defaultdict(set)
    for p, v in kept:
        by_token[min(p)].add((p, v))
    for i in sets:
        if not fixed[i]:
            fits = [(kept[k], k[1]) for t in sets[i] for k in by_token[t] if k[0] <= sets[i]]
            top = max((m for m, _ in fits), default=None)
            want = {v for m, v in fits if m == top} if fits else {"allow"}
            assert got[i].verdict == ("block" if "block" in want else "allow")
    none = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in urlrules.judge(none).collect()] == ["allow"]
    assert urlrules.judge(none.limit(0)).count() == 0


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(CHAT_SQL.strip()).fetchall()
    got = [tuple(r) for r in op1_chat_format(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(want)


def test_vectors_that_share_an_id(spark):
    near = lambda *x: [float(v) for v in x]
    rows = [(1, near(1, 0)), (1, near(0, 1)), (2, near(1, 0.1)), (3, near(0.1, 1)), (4, near(0.05, 1))]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_no_link_depends_on_the_size(spark, monkeypatch):
    """All vectors in one part, and in hundreds: the components of every pair, none missing."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((12, 16)))
    own = np.repeat(base, 125, 0)
    side = rng.standard_normal(own.shape)
    side = unit(side - (side * own).sum(1, keepdims=True) * own)
    cosine = rng.uniform(0.91, 0.999, (len(own), 1))
    x = unit(cosine * own + np.sqrt(1 - cosine * cosine) * side)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.9
    want = closure(range(len(x)), [tuple(map(int, p)) for p in np.argwhere(np.triu(near, 1))])
    for part in (4096, 32):
        monkeypatch.setattr(neardup, "PART", part)
        got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
        assert all(got[i].n_links == near[i].sum() - 1 for i in got)
        assert all(got[i].component_id == want[i] for i in want) and len(set(want.values())) > 5
    one = neardup.plan(x, len(x))
    assert len(one.cuts) >= 32 and np.bincount(one.keys(x @ one.directions)).max() <= 64
