"""Queries of this subpackage against DuckDB, and the rest on whole tables for their shape."""

import glob
import os

import duckdb
import pytest

from sieveflow.llm import queries as Q


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, sf, tables, name):
    df = Q.queries()[name](spark, sf)
    rel = tables.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
