"""Every engine query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pytest

from spanlake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda d: sorted(tuple(round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in d[names].astype(object).where(d[names].notna(), "null").itertuples(index=False))
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or float(u) == pytest.approx(float(v), abs=2e-5) for u, v in zip(x, y, strict=True))
