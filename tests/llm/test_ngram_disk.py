"""What the n-gram join sends over and leaves behind: clusters in place of one grid, no files of ended steps."""

import glob
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terracell.llm import ngram_join
from terracell.llm.common import FREE_SETTING
from tests.llm.brute import near_components


def families(prose, count, size=24, n=100):
    """Groups of texts some of which are near each other but not near their group's representative."""
    rows = []
    for family in range(count):
        rnd, base = random.Random(family), prose(n, 500 + family).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(n)] = f"new{rnd.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def sent_to_blocks(spark, rows, monkeypatch):
    """Rows that the sides of the block comparison get, and the components."""
    left, right = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = ngram_join.compare_blocks

    def counted(a, b, num, den):
        left.add(a.num_rows)
        right.add(b.num_rows)
        return real(a, b, num, den)

    monkeypatch.setattr(ngram_join, "compare_blocks", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    monkeypatch.setattr(ngram_join, "compare_blocks", real)
    return left.value + right.value, got


def test_more_families_are_no_larger_grid(spark, prose, monkeypatch):
    """Four times the families: four times the rows, not sixteen times; components are those of all pairs."""
    monkeypatch.setattr(ngram_join, "KEY_MEMBERS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    few, got_few = sent_to_blocks(spark, families(prose, 5), monkeypatch)
    many, got_many = sent_to_blocks(spark, families(prose, 20), monkeypatch)
    assert got_few == near_components(families(prose, 5))
    assert got_many == near_components(families(prose, 20))
    assert 0 < few and many < 8 * few, (few, many)


@pytest.mark.parametrize("own", [None, "false"])
def test_steps_leave_no_shuffle_files(spark, prose, tmp_path, own):
    """Files of shuffles that ended inside the operator are gone when it returns; the session keeps its setting."""
    session = spark.newSession()
    if own is not None:
        session.conf.set(FREE_SETTING, own)
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    session.range(1000).repartition(3, F.col("id")).write.parquet(f"{tmp_path}/plain")
    before = files()
    assert before
    df = session.createDataFrame(families(prose, 3), "doc_id long, text string")
    out = ngram_join.jaccard_components(df)
    assert not files() - before
    assert out.count() == 72
    assert session.conf.getAll.get(FREE_SETTING) == own


def test_a_key_is_sent_once(prose):
    """Rows that are dealt by their key have no copy of it; other copies of a hot key are dealt by node."""
    texts = [prose(80, 950)] + [prose(80, 960) + f" end{k}" for k in range(12)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(13)), "text": texts, "text_key": pa.array(range(13))})
    sent = pa.Table.from_batches(ngram_join.send_batches(iter([batch]), 5, 3, 4))
    keys = sent.filter(pa.compute.greater_equal(sent["x"], 0)).to_pandas()
    hot = (keys.x & ngram_join.HOT_BIT) != 0
    first = ~keys.duplicated("key")
    assert hot.any() and not hot.all()
    assert (keys.deal.isna() == (first | ~hot)).all()
    assert keys.key.dtype == np.int64 and sent["key"].null_count == 0
