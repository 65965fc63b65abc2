"""Every registered query with a DuckDB equivalent, side by side on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "events", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    out = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())
