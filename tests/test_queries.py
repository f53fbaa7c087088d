"""Every plan query against its SQL on DuckDB, at the smallest scale."""

import glob
import os

import pytest

from lexiforge.plans.oracle import oracle_sql
from lexiforge.plans.queries import NAMES, queries


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in NAMES if n in oracle_sql()])
def test_query(spark, sf, duck, name):
    got = queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(NAMES) <= set(__spark_entry__.queries())
