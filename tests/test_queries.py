"""Every query with SQL, held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge.plans import scalar_queries  # noqa: F401
from tallyforge.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return round(float(v), 9) if type(v).__name__ in ("float", "Decimal") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    order = sorted(df.columns)
    assert sorted(cols) == order
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
