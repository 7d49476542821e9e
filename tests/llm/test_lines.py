import random

import duckdb

from tidemark.llm import linededup
from tidemark.llm.queries import LINES_SQL, op10_line_dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    lines = [((d, i), x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda r: (r[0][0] is not None, r[0]))
    earlier, gone = [], set()
    for at, x in lines:
        if len(x) >= linededup.MIN_CHARS or x.strip(" \t\n\x0b\x0c\r"):
            if x in earlier or len(x) >= linededup.MIN_CHARS and any(near(x, y) for y in earlier if len(y) >= linededup.MIN_CHARS):
                gone.add(at)
            earlier.append(x)
    return [(d, 0, 0, None) if t is None else (d, len(p := t.split("\n")), sum((d, i) in gone for i in range(len(p))), "\n".join(x for i, x in enumerate(p) if (d, i) not in gone)) for d, t in rows]


def edit(rng, x):
    k = rng.randrange(len(x) + 1)
    return rng.choice([x[:k] + rng.choice("abé😀 ") + x[k:], x[:k] + x[k + 1 :], x[:k] + "z" + x[k + 1 :], x])


def test_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([5, 19, 20, 21, 63, 64, 65, 127, 128, 129, 300]))) for _ in range(60)] + ["a" * 40, "ab" * 32, "a" * 64, "😀" * 65]
    rows = []
    for d in range(150):
        rows.append((d, "\n".join(x if rng.random() < 0.3 else edit(rng, edit(rng, x)) if rng.random() < 0.5 else edit(rng, x) for x in rng.choices(base, k=rng.randrange(6)))))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "short"), (904, base[3] + "\r"), (905, "x" * 100_000), (906, "x" * 99_999 + "y"), (None, base[10])]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, line string, h int")
    got = [tuple(r) for r in linededup.dedup(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    cleaned = linededup.clean_documents(df.withColumnRenamed("h", "n_chars"))
    assert cleaned.columns == ["doc_id", "text", "line", "n_chars"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cleaned.collect())
    assert linededup.dedup(df.limit(0)).count() == 0
    twice = linededup.dedup(df.filter("doc_id = 905 or doc_id = 3").unionByName(df.filter("doc_id = 3"))).collect()
    assert len(twice) == 3


def test_short_repeats_go(spark):
    rng = random.Random(4)
    base = ["}", "Yes.", "x" * 19, "y" * 20, "", "  ", "Table of contents: 1", "é", "z" * 40]
    rows = [(d, "\n".join(rng.choices(base, k=6))) for d in range(30)]
    seen, want = set(), {}
    for d, t in rows:
        left = []
        for x in t.split("\n"):
            if not x.strip() or x not in seen:
                left.append(x)
            seen.add(x)
        want[d] = "\n".join(left)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(df).collect()} == want
    assert {r.doc_id: r.text for r in linededup.clean_documents(df).collect()} == want
    near = spark.createDataFrame([(1, "y" * 20 + "\n" + "w" * 19), (2, "y" * 19 + "v\n" + "w" * 18 + "v")], "doc_id long, text string")
    assert [r.text for r in linededup.dedup(near).orderBy("doc_id").collect()] == ["y" * 20 + "\n" + "w" * 19, "w" * 18 + "v"]


def test_short_lines_stay_where_asked(spark):
    df = spark.createDataFrame([(1, "a\n" + "w" * 19), (2, "a\n" + "w" * 19)], "doc_id long, text string")
    assert sum(r.n_dropped for r in linededup.dedup(df).collect()) == 2
    assert sum(r.n_dropped for r in linededup.dedup(df, shortest=19).collect()) == 1
    assert sum(r.n_dropped for r in linededup.dedup(df, shortest=20).collect()) == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(LINES_SQL.strip()).fetchall()
    got = [tuple(r) for r in op10_line_dedup(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[2] for r in got) > 10
