"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessella.plans import catalog, oracle


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return connection


@pytest.mark.parametrize("name", [query.__name__ for query in catalog.QUERIES])
def test_same_rows(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = duck.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
