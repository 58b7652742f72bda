"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import collections
import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
SLOW = {"p3_paths", "p3_descendants", "p1_classes"}
NAMES = [n for n in __spark_entry__.oracle_sql() if n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    answer = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = collections.Counter(tuple(plain(r[i]) for i in order) for r in answer.fetchall())
    assert got == want


def test_names_are_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
