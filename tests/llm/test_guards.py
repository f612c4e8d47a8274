"""What the text operators may not do."""

import glob
import os

import duckdb
import pytest

from terracell.llm.queries import QUERIES, SQL

from .conftest import SMALL

HERE = os.path.dirname(__file__)
FILES = [
    *glob.glob(os.path.join(HERE, "..", "..", "terracell", "llm", "*.py")),
    os.path.join(HERE, "..", "..", "corpus_pipeline.py"),
]


def test_words_that_have_no_place():
    assert len(FILES) > 10
    for f in FILES:
        text = open(f).read()
        for word in ("crossJoin", "localCheckpoint", ".rdd", "mkdtemp", "except ImportError", "toPandas"):
            assert word not in text, (f, word)


@pytest.mark.parametrize("name", ["op2_secret_scan", "op4_license_scan", "op6_sharding", "op10_quality_rules"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_values_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
