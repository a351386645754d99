"""Every registered query against its SQL oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of, type_differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert not type_differences(df.dtypes, {d[0]: str(d[1]) for d in cur.description})
        assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
