"""Every query of the engine against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from weftgraph.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(([plain(r[c]) for c in sorted(got.columns)] for r in got.collect()), key=key)
    if name not in ORACLE:
        assert rows
        return
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    theirs = sorted(([plain(x) for x in r] for r in con.sql(f"select {', '.join(sorted(want.columns))} from ({ORACLE[name]})").fetchall()), key=key)
    assert rows == theirs
