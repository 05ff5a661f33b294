"""The driver's contract, and queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(catalogue.cases()))
def test_stated_case(spark, duck, name):
    fn, sql = catalogue.cases()[name]
    df = fn(spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want
