"""Every registered graph query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from weftgraph.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that SQL can't express: test_forms holds them against plain algorithms.
WITHOUT = {"mst_edges"}
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def in_order(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name not in registry.ORACLES:
        assert name in WITHOUT and rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert in_order(rows, found.columns) == in_order(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
