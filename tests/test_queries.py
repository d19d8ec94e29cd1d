"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(frame):
    def plain(v):
        if v is None or v is not v or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
            return ""
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_redundant_links_of_parts(spark, small):
    parts = QUERIES["redundant_links_all"](spark, small).where("dependent between 4000000000 and 4999999999")
    assert parts.count() == spark.read.parquet(f"{small}/lineitem.parquet").where("l_partkey % 10 = 0").select("l_partkey").distinct().count() > 0
