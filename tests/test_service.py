"""Point hypotheses and decisions on random matches, against SQL that states which rows belong to the result."""

import random

import duckdb

from tidemark.plans import decode, service
from tidemark.queries.points import DECODED_SQL, HYPOTHESES_SQL

SCHEMAS = {
    "serves": "m int, serve_id long, strike double, setup double, end string, half string, team string, score double",
    "strokes": "m int, stroke_id long, t double, end string",
    "bouts": "m int, start double, end double, transition double",
    "durations": "m int, duration double",
}


def random_matches(rng, n):
    """Rows of all tables; times on a grid of a quarter second, so limits are met exactly, but not two serves or strokes at one time."""
    rows = {name: [] for name in SCHEMAS}
    for m in range(n):
        times = lambda k: sorted(rng.sample(range(800), k))
        for i, t in enumerate(times(rng.choice([0, 2, 6, 12]))):
            rows["serves"].append((m, i, t / 4, t / 4 - rng.choice([0.5, 2.0]), rng.choice(["near", "far", None]), rng.choice(["left", "left", None]), rng.choice(["", "a", "b", None]), rng.choice([None, 0.5, 0.8])))
        for i, t in enumerate(times(rng.choice([0, 20, 60]))):
            rows["strokes"].append((m, i, t / 4 + 0.05, rng.choice(["near", "far", "far", None, "x"])))
        at = 0.0
        while at < 180:
            start = at + rng.choice([0.5, 1.0, 3.0, 12.0])
            at = start + rng.choice([1.0, 5.5, 6.0, 14.0])
            rows["bouts"].append((m, start, at, rng.choice([None, None, at - 0.25, at + 6.0])))
        rows["durations"].append((m, 190.0))
    return rows


def ask(rows, sql):
    con = duckdb.connect()
    for name, schema in SCHEMAS.items():
        kinds = {c.split()[0]: {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}[c.split()[1]] for c in schema.split(", ")}
        con.execute(f"CREATE TABLE {name} ({', '.join(f'"{c}" {k}' for c, k in kinds.items())})")
        if rows[name]:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(kinds))})", rows[name])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def same(df, names, want):
    got = sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    assert got == sorted(map(str, want))
    return len(got)


def test_hypotheses_and_decisions_equal_sql(spark):
    rows = random_matches(random.Random(8), 40)
    tables = {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}
    hyp = service.point_hypotheses(tables["serves"], tables["strokes"], tables["bouts"], ["m"], float(1 << 20)).cache()
    names, want = ask(rows, f"WITH RECURSIVE {HYPOTHESES_SQL} SELECT * FROM hyp")
    assert same(hyp, names, want) > 200
    kinds = {r[names.index("kind")] for r in want} | {r[names.index("classification")] for r in want}
    assert kinds == {"serve", "exchange", "live_state", "returned_serve", "serve_with_play", "unreturned_serve", "exchange_only", "play_only"}
    decisions, turns = decode.decoded(hyp, tables["strokes"], ["m"], 190.0)
    names, want = ask(rows, f"WITH RECURSIVE {HYPOTHESES_SQL},{DECODED_SQL} SELECT * EXCLUDE (duration) FROM fin")
    same(decisions, names, want)
    assert {r[names.index("dropped")] for r in want} == {None, "too_short", "unexplained_tail"}
    assert {r[names.index("source")] for r in want} == {"calm_stretch", "live_end", "bounded_window"}
    taken = turns.groupBy("m", "no").count().collect()
    served = {(r.m, r.no): r.accepted_actions for r in decisions.filter("kind = 'serve'").collect()}
    assert {(r.m, r.no): r["count"] for r in taken} == {k: n for k, n in served.items() if n}
    hyp.unpersist()


def test_no_rows_and_null_times(spark):
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    assert service.point_hypotheses(empty["serves"], empty["strokes"], empty["bouts"], ["m"], 200.0).count() == 0
    serves = spark.createDataFrame([(1, 0, None, None, "near", None, None, 0.9), (1, 1, 20.0, None, "near", None, None, 0.9)], SCHEMAS["serves"])
    strokes = spark.createDataFrame([(1, 0, None, "far"), (1, 1, 21.0, "far")], SCHEMAS["strokes"])
    hyp = service.point_hypotheses(serves, strokes, empty["bouts"].drop("transition"), ["m"], 200.0)
    (row,) = decode.decoded(hyp, strokes, ["m"], 200.0)[0].collect()
    assert (row.classification, row.start, row.last_action, row.end, row.source, row.accepted_actions, row.dropped) == ("returned_serve", 20.0, 21.0, 26.0, "bounded_window", 1, "unexplained_tail")
    (told,) = decode.quality(decode.decoded(hyp, strokes, ["m"], 200.0)[0], ["m"], 200.0).collect()
    assert (told.n, told.violations, told.rejected, told.median_gap) == (0, 0, False, None)
    assert decode.decoded(hyp.limit(0), strokes, ["m"], 200.0)[0].count() == 0


def test_promotion(spark):
    schema = SCHEMAS["serves"] + ", evidence boolean, accepted boolean"
    row = lambda i, score, evidence, accepted, end="near": (1, i, 10.0 * i, 10.0 * i, end, None, None, score, evidence, accepted)
    serves = spark.createDataFrame([row(0, 0.1, False, True), row(1, 0.52, True, False), row(2, 0.51, True, False), row(3, 0.9, None, None), row(4, 0.9, True, False, "far"), row(5, None, True, False)], schema)
    strokes = spark.createDataFrame([(1, i, 10.0 * i + 2, "far") for i in range(6)], SCHEMAS["strokes"])
    assert {r.serve_id for r in decode.promoted(serves, strokes, ["m"]).filter("accepted").collect()} == {0, 1}


def test_quality_rejects_tiles(spark):
    schema = "m int, no int, kind string, start double, end double, tail double, accepted_actions long, dropped string"
    tiles = [(1, i, "serve", i * 10.0, i * 10.0 + 9.8, 0.0, 2, None) for i in range(3)]
    apart = [(2, i, "serve", i * 10.0, i * 10.0 + 5, 0.0, 0, None) for i in range(3)] + [(2, 3, "serve", 30.0, 31.0, 9.0, 0, "too_short")]
    told = {r.m: r for r in decode.quality(spark.createDataFrame(tiles + apart, schema), ["m"], 30.0).collect()}
    assert told[1].rejected and told[1].reason == "tiled_source" and not told[1].warned
    assert not told[2].rejected and told[2].warned and told[2].n == 3 and told[2].median_gap == 5.0
