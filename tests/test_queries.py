"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tempoloom import queries as Q

SF = "/root/testdata/sf0.001"
SLOW = {"betweenness_of_edges", "combined_centrality", "retrieved_relations", "pagerank_10_rounds", "component_of_first_node"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df, columns):
    show = lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - SLOW))
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name not in Q.ORACLE:
        assert len(got.columns)
        return
    want = con.execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_names_of_sql_are_names_of_queries():
    assert set(Q.ORACLE) <= set(Q.QUERIES)
