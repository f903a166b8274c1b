"""Queries of the training-data operators against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessella.llm import queries


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, data, duck, name):
    got = queries.queries()[name](spark, data).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    columns = sorted(got.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))
