"""Every catalogued query against the SQL that stands beside it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from auditspark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    place = {d[0]: i for i, d in enumerate(want.description)}
    assert columns == sorted(place)
    a = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    b = sorted(repr(tuple(r[place[c]] for c in columns)) for r in want.fetchall())
    assert a == b


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
