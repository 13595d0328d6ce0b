"""Every trace query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

from tracelake.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def rows(names, table, order):
    at = [names.index(c) for c in order]
    value = lambda v: round(v, 7) if isinstance(v, float) else v
    return sorted((repr(tuple(value(r[i]) for i in at)) for r in table))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    cur = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()], order) == rows(names, cur.fetchall(), order)
