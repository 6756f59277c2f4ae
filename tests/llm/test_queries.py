"""Queries of the training-data operators on the smallest tables."""

import glob
import os

import duckdb
import pytest

from latentia.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = sorted(map(str, (tuple(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, sf_dir).collect())))
    con = duck.execute(queries.ORACLES[name])
    cols = [c[0] for c in con.description]
    assert got == sorted(map(str, (tuple(sorted(zip(cols, r))) for r in con.fetchall())))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
