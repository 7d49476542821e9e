import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, row string, k string"


def documents(n, seed=3):
    rng = random.Random(seed)
    hot = "copy " * 40
    rows = [(i, rng.choice([hot, "w" * int(10 ** rng.uniform(0, 3.3))]), rng.choice(["en", "de", None]), rng.choice(["hot"] * 4 + ["a", "b", None]), rng.choice([None, i]), "x", "y", "z") for i in range(n)]
    return rows + [(n, None, None, None, None, "x", "y", "z"), (n + 1, "", "en", "a", 0, "x", "y", "z"), (None, "no id", "en", "a", 5, "x", "y", "z")] + [(7, "seven " * 9, "en", "a", 54, "x", "y", "z")] * 90


def check(rows, got, leaves):
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < leaves
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in shards.items()}


def test_near_equal_bytes_whatever_the_order_of_rows(spark):
    rows = documents(3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.digests(df, shards=7).collect()
    sums = check(rows, got, 7)
    assert len(sums) == 7 and max(sums.values()) - min(sums.values()) <= 2 * max(r.size for r in got)
    again = sharding.digests(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5), shards=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_tree(cells, dims, leaves):
    """The same cuts by plain recursion over the cells."""
    spans = [max(max(c[d] for c in cells) - min(c[d] for c in cells), 1) for d in range(dims)]
    leaf = {}

    def cut(own, first, into):
        if into == 1 or not own:
            leaf.update(((*c[:-2],), first) for c in own)
            return
        wide = [(max(c[d] for c in own) - min(c[d] for c in own)) / spans[d] for d in range(dims)]
        d, low, done, whole = wide.index(max(wide)), [], 0, sum(c[-1] for c in own)
        own = sorted(own, key=lambda c: (c[d], *c[:-2]))
        for c in own:
            if (done + c[-1] / 2) * into <= whole * (into // 2):
                low.append(c)
            done += c[-1]
        cut(low, first, into // 2)
        cut(own[len(low) :], first + into // 2, into - into // 2)

    cut(cells, 0, leaves)
    return leaf


def test_tree_and_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 8)
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.choice([0, 0, 0, rng.randrange(9)]), rng.choice([5, rng.randrange(1 << 62)]), i, rng.choice([1, 50, 2000])) for i in range(800)]
    df = spark.createDataFrame(rows, "c0 long, c1 long, k long, u long, size long").select("*", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("lo2"))
    cells, rounds = sharding.cells_of(df, 2, 5)
    found = [tuple(r) for r in cells.collect()]
    total, n = sum(r[4] for r in rows), len(rows)
    assert rounds and sum(c[-2] for c in found) == n and sum(c[-1] for c in found) == total
    assert all(c[-2] == 1 or c[-1] <= total / 40 and c[-2] <= n / 40 for c in found)
    got = {tuple(r)[:-4]: r.leaf for r in sharding.tree(cells, 2, 5).collect()}
    assert got == brute_tree(found, 2, 5)


def test_edges(spark, tmp_path):
    df = spark.createDataFrame(documents(50), SCHEMA)
    assert sharding.digests(df.limit(0), shards=4).count() == 0
    one = sharding.digests(df.filter("doc_id = 3"), shards=4).collect()
    assert [(r.slot) for r in one] == [0]
    dims = {"lang": sharding.category(F.col("lang")), "size": sharding.magnitude(F.length("text"))}
    kept = sharding.split(df, dims, F.length("text"), target_bytes=1000)
    assert set(kept.columns) == {*df.columns, "size", "shard"} and kept.select("shard").distinct().count() > 3
    nothing = sharding.split(df, dims, F.lit(None), leaves=3)
    assert nothing.count() == df.count() and nothing.filter("size <> 0").count() == 0
    huge = spark.createDataFrame([(1, "x" * 300_000, "en", "a", 1, "", "", ""), *documents(20)], SCHEMA)
    check([tuple(r) for r in huge.collect()], sharding.digests(huge, shards=4).collect(), 4)
    sharding.write_shards(df, str(tmp_path / "out"), dims=dims, size=F.length("text"), leaves=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and back.select("shard").distinct().count() == 3
