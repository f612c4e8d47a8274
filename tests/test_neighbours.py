"""Nearest rows by boxes: the same fill as by all blocks, with few meetings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terracell.operators import neighbours, prep

NAMES = ["a", "b", "c"]


def rows(n, whole, seed):
    """``whole`` gives many equal distances; keys repeat, and some are null."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        values = [rnd.randrange(5) * 1.0 if whole else rnd.gauss(0, 1) for _ in NAMES]
        key = None if i % 50 == 7 else i // 2 if i % 5 == 0 else 10_000 + i
        out.append((key, *[None if rnd.random() < 0.2 else float("nan") if rnd.random() < 0.02 else v for v in values]))
    return out + out[:20]


def filled(asks, donors, block):
    got = prep.knn_values(asks, donors, NAMES, k=3, block_rows=block).collect()
    return {r[0]: tuple(None if v is None else round(v, 9) for v in r[1:]) for r in got}


@pytest.mark.parametrize("whole", [True, False])
def test_boxes_fill_as_all_blocks_do(spark, monkeypatch, whole):
    asks, donors = (spark.createDataFrame(rows(n, whole, n), "hex_code long, a double, b double, c double") for n in (150, 400))
    boxed = filled(asks, donors, 40)
    monkeypatch.setattr(neighbours, "MOST_ASKS", 3)  # crowded boxes are split
    monkeypatch.setattr(neighbours, "MOST_PAIRS", 50)
    parts = filled(asks, donors, 40)
    monkeypatch.setattr(prep, "BOXED_COLUMNS", 0)
    assert boxed and filled(asks.filter("hex_code IS NOT NULL"), donors, 5000) == {k: v for k, v in boxed.items() if k is not None}
    assert parts == boxed


def test_a_row_meets_few_boxes(spark):
    x = spark.range(8000).select(F.col("id").alias("hex_code"), *[(F.xxhash64("id", F.lit(c)) % 10000).cast("double").alias(c) for c in NAMES])
    asks = x.filter("id % 10 = 0").withColumn("c", F.lit(None).cast("double"))
    found = neighbours.nearest(asks, x.withColumn("hex_code", F.col("hex_code") + 8000), NAMES, "hex_code", 5, 100)
    assert 800 * 5 <= found.count() < 800 * 5 * 4  # all blocks of 100 donors send 80 times 5
    assert found.filter("dist = 0").count() == 800
