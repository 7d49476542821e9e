"""Every query with SQL gives the SQL's rows on the driver's tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict(recursive=True).items())) for r in df.collect()), key=repr)
    assert len(got) == len(want) and len(want) > 0
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
