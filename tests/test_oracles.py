"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quire import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def tidy(row):
    return tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(map(tidy, df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    want = sorted(map(tidy, con.execute("select " + ",".join(f'"{c}"' for c in cols) + f" from ({q.ORACLES[name]})").fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert q.entry(spark).count() > 0


def test_epub_package(spark):
    got = q.QUERIES["epub_package"](spark, DIR)
    assert got.where("not valid or error <> ''").count() == 0
