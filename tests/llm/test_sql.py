"""The training-data queries that have SQL, held against it column by column."""

import duckdb
import pytest

from weftgraph.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert sorted(tuple(r) for r in made.select(columns).collect()) == sorted(want.select(*columns).fetchall())
