"""Registered queries against their SQL in DuckDB.

A sample runs by default; ``CATALOG=all`` checks every query, ``CATALOG=f10,s01`` the
ones with those prefixes.  Columns compare by name, rows without order.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = "s01 s07 s13 s15 s20 p13 p25 j02 j04 j15 j18 j19 a02 a08 a12 a20 a22 b02 b04_single w08 w10 w19 f01 f14 f18 f22 f37 e02 e03 e05 e06 e07 e10 e11 e12 e19 e20 e22 e24 e25 o08".split()
ORACLES = entry.oracle_sql()


def wanted(name):
    choice = os.environ.get("CATALOG")
    if choice == "all":
        return True
    prefixes = choice.split(",") if choice else SAMPLE
    return any(name.startswith(p) for p in prefixes)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", [n for n in ORACLES if wanted(n)])
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
    assert got


def test_entry_contract():
    names = entry.queries()
    assert set(ORACLES) <= set(names)
    assert all(callable(f) for f in names.values())
