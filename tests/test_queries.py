"""Every query against its reference SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    r = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)
