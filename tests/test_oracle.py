"""Every query with SQL gives the rows of its SQL, column by column."""

import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import MODULES

SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x if isinstance(x, int) else str(x)[:19].replace(" 00:00:00", "")


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(x) for x in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.execute(SQL[name]).fetchdf())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(ours[1], theirs[1]):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-4 * max(1.0, abs(y)) * 1e-2) for x, y in zip(a, b)), (a, b)
