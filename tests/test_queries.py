"""Registered queries against their SQL; ATTESTA_QUERIES=name,name runs some of them only."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from attesta.plans import catalogue

ROOT = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def canon(rows, order):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


WANTED = [w for w in os.environ.get("ATTESTA_QUERIES", "").split(",") if w]


@pytest.mark.parametrize("name", WANTED or sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    names = sorted(cols)
    assert canon([tuple(r) for r in df.collect()], [df.columns.index(c) for c in names]) == canon(cur.fetchall(), [cols.index(c) for c in names])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
