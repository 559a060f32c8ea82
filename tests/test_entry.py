import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(d):
    return sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(tables.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    r = entry.entry(spark).first()
    assert r["n"] == 1500 and r["logz"] < 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark):
    got = QUERIES["stream_order_test"](spark, SF)
    assert got.agg({"rows": "sum"}).first()[0] == 1000
