"""Every registered query runs; those with an oracle statement give the same values."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools_check import normal

D = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_values(spark, con, name):
    df = QUERIES[name](spark, D)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_no_broadcast_hints_or_cross_joins():
    """In the library; the text operators broadcast behind size checks and have a guard of their own."""
    for f in glob.glob(os.path.join(os.path.dirname(__file__), "..", "terracell", "**", "*.py"), recursive=True):
        if os.path.join("terracell", "llm") in f:
            continue
        text = open(f).read()
        for word in ("crossJoin", "broadcast(", "localCheckpoint", ".rdd"):
            assert word not in text, (f, word)
