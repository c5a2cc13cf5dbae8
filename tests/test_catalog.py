"""Registered queries against their SQL over the smallest tables, and the driver's contract."""

import glob
import hashlib
import os

import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, engine, name):
    got = catalog.queries()[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in SQL:
        expected = engine.execute(SQL[name])
        names = [d[0] for d in expected.description]
        assert sorted(names) == sorted(got.columns)
        assert plain(rows, got.columns) == plain(expected.fetchall(), names)


def test_sql_is_for_known_queries():
    assert set(SQL) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.count() > 200 and set(catalog.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert hashlib.sha256(repr(sorted(got.columns)).encode()).hexdigest()
