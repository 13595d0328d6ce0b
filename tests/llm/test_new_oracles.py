"""Operators 11 to 13 on the tables against their SQL."""

import os

import duckdb
import pytest

from tracelake.llm import queries


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_bit_sliced_negatives", "op13_ball_tree_clusters"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
