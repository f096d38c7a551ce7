"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = sorted(catalog.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    return sorted(tuple("" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(catalog.ORACLES[name])
    assert sorted(c[0] for c in found.description) == names
    at = [[c[0] for c in found.description].index(n) for n in names]
    assert plain(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == plain(tuple(r[i] for i in at) for r in found.fetchall())


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
