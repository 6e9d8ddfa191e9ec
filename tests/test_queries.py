"""Every query with SQL gives the same rows as that SQL, the others run."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from chartula.plans import cases, oracles, queries

QUERIES, ORACLES = queries.QUERIES | cases.CASES, oracles.ORACLES | cases.CASE_ORACLES


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, int, np.integer)):
        return round(float(v), 6)
    return str(v)


def bag(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(plain(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


#: Queries whose feature may find nothing in the smallest tables.
MAY_BE_EMPTY = {"repeated_stamps"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    assert rows or name in MAY_BE_EMPTY


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
