"""Every registered query of the retrieval operators against its SQL."""

import decimal
import math

import duckdb
import pytest

from vecmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.5f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
