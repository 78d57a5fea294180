import os

import duckdb
import pytest

import __spark_entry__ as entry
from aksharaflow.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    rows = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        assert rows.count() > 0
        return
    con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in con.description]
    want = con.fetchall()
    assert sorted(names) == sorted(rows.columns)
    got = [tuple(plain(r[c]) for c in names) for r in rows.collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
