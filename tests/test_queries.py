"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from graphloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    theirs = duck.sql(queries.ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in mine.collect())
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in theirs.fetchall())
    assert a == b


def test_every_query_has_rows_or_a_schema(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
