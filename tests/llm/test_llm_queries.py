import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textgrove.llm import queries


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = queries.SQL.get(name)
    if sql:
        r = duck.sql(sql)
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert rows == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
