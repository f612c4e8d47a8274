"""Positions in an order without one task holding one group.

A plain ``row_number`` window sends a whole group to one task, and a window without partition
keys sends everything there. Both functions cut the order into buckets first, number the rows
inside a bucket, and add the running size of the earlier buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions.util import md5_order


def _offsets(df: DataFrame, by: Sequence[str], bucket: str, weight: Column) -> DataFrame:
    """Rows before each bucket, per group. Input here is one row per (group, bucket)."""
    sizes = df.groupBy(*by, bucket).agg(weight.alias("_size"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*by, bucket)],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )


def _with_offsets(df: DataFrame, offsets: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    on = F.lit(True)
    for c in (*by, bucket):
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(offsets, on).drop(*[f"_k_{c}" for c in (*by, bucket)])


def shuffled_position(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    name: str = "position",
    digits: int = 3,
) -> DataFrame:
    """1-based position of each row in a seeded shuffle of its group.

    The shuffle orders by an md5 of the keys, so its first hex digits are even buckets whatever
    the data looks like: 16^digits tasks' worth of work per group.
    """
    work = df.withColumn("_h", md5_order(*keys, seed=seed)).withColumn(
        "_bucket", F.substring("_h", 1, digits)
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy("_h", *keys)
    ranked = work.withColumn("_rn", F.row_number().over(inner))
    offsets = _offsets(work, by, "_bucket", F.count(F.lit(1)))
    return (
        _with_offsets(ranked, offsets, by, "_bucket")
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_h", "_bucket", "_rn", "_before")
    )


def value_splits(df: DataFrame, value: str, parts: int | None = None) -> list[float]:
    """Range boundaries for a numeric column; a handful of numbers on the driver."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    return sorted(set(df.approxQuantile(value, cuts, min(0.01, 1 / (4 * parts)))))


def range_bucket(df: DataFrame, value: str, splits: Sequence[float], name: str) -> DataFrame:
    """Monotone bucket number of a value by fixed boundaries."""
    if not splits:
        return df.withColumn(name, F.lit(0.0))
    edges = [float("-inf"), *splits, float("inf")]
    return Bucketizer(splits=edges, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def value_positions(
    df: DataFrame, value: str, by: Sequence[str] = (), splits: Sequence[float] | None = None
) -> DataFrame:
    """One row per group and distinct value: ``ties`` rows hold it, ``below`` rows are smaller.

    Counting equal values first means a value held by a third of the rows is one row here.
    """
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    if splits is None:
        splits = value_splits(df, value)
    cut = range_bucket(distinct, value, splits, "_bucket")
    inner = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = cut.withColumn("_in", F.coalesce(F.sum("ties").over(inner), F.lit(0)))
    offsets = _offsets(cut, by, "_bucket", F.sum("ties"))
    return (
        _with_offsets(ranked, offsets, by, "_bucket")
        .withColumn("below", F.col("_before") + F.col("_in"))
        .select(*by, value, "ties", "below")
    )


def column_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of several columns: one job for the ranges, one for the values.

    Every column has its own range boundaries; counted values are ordered inside (column, range)
    only. A few numbers per column come back to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = (
        slim.approxQuantile(list(columns), [i / parts for i in range(1, parts)], min(0.01, 1 / (4 * parts)))
        if parts > 1
        else [[] for _ in columns]
    )
    edges = [[float("-inf"), *(sorted(set(f)) or [0.0]), float("inf")] for f in found]
    marks = [f"_b{i}" for i in range(len(columns))]
    cut = Bucketizer(splitsArray=edges, inputCols=list(columns), outputCols=marks, handleInvalid="keep").transform(slim)
    items = F.array(
        *[
            F.struct(F.lit(i).alias("column"), F.col(m).alias("bucket"), F.col(c).alias("value"))
            for i, (c, m) in enumerate(zip(columns, marks, strict=True))
        ]
    )
    counted = (
        cut.select(F.explode(items).alias("e"))
        .select("e.*")
        .filter("value IS NOT NULL")
        .groupBy("column", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    inner = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_in", F.coalesce(F.sum("ties").over(inner), F.lit(0)))
    offsets = _offsets(counted, ["column"], "bucket", F.sum("ties"))
    placed = _with_offsets(ranked, offsets, ["column"], "bucket").withColumn("below", F.col("_before") + F.col("_in"))
    totals = counted.groupBy("column").agg(F.sum("ties").alias("total"))
    placed = placed.join(totals, "column")
    picks = []
    for j, q in enumerate(qs):
        at = F.lit(q) * (F.col("total") - 1)
        for name, rank in ((f"lo{j}", F.floor(at) + 1), (f"hi{j}", F.ceil(at) + 1)):
            stands = (F.col("below") < rank) & (rank <= F.col("below") + F.col("ties"))
            picks.append(F.max(F.when(stands, F.col("value"))).alias(name))
    rows = placed.groupBy("column", "total").agg(*picks).collect()
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in columns}
    for r in rows:
        for j, q in enumerate(qs):
            at = q * (r["total"] - 1)
            lo, hi = r[f"lo{j}"], r[f"hi{j}"]
            out[columns[r["column"]]][j] = lo + (hi - lo) * (at - math.floor(at))
    return out


def average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank with ties averaged, joined back on the value; null values get a null rank."""
    ranks = value_positions(df, value, by).select(
        *by,
        F.col(value).alias("_v"),
        (F.col("below") + (F.col("ties") + 1) / F.lit(2.0)).alias(name),
    )
    left = df.withColumn("_v", F.col(value).cast("double"))
    return left.join(ranks, [*by, "_v"], "left").drop("_v")


def value_at_rank(positions: DataFrame, value: str, rank: Column) -> DataFrame:
    """The value standing at a 1-based rank, from ``value_positions``."""
    hit = (F.col("below") < rank) & (rank <= F.col("below") + F.col("ties"))
    return positions.filter(hit).select(value)


def value_order_positions(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """1-based position of each row by value within its group, ties in shuffled key order.

    Rows are cut into value ranges. A value common enough to be a boundary twice gets a range of
    its own, and that range is cut again by the hash of the key, so ties of any size are spread.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = (
        df.approxQuantile(value, [i / parts for i in range(1, parts)], min(0.01, 1 / (4 * parts)))
        if parts > 1
        else []
    )
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    splits = sorted({*cuts, *[math.nextafter(h, math.inf) for h in hot]})
    spread = range_bucket(df, value, splits, "_vb")
    is_hot = F.col(value).isin(hot) if hot else F.lit(False)
    work = (
        spread.withColumn("_h", F.when(is_hot, md5_order(key)).otherwise(F.lit("")))
        .withColumn("_bucket", F.concat(F.lpad(F.col("_vb").cast("int").cast("string"), 8, "0"), F.substring("_h", 1, 3)))
        .drop("_vb")
    )
    inner = Window.partitionBy(*by, "_bucket").orderBy(value, "_h", key)
    ranked = work.withColumn("_rn", F.row_number().over(inner))
    offsets = _offsets(work, by, "_bucket", F.count(F.lit(1)))
    return (
        _with_offsets(ranked, offsets, by, "_bucket")
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_h", "_bucket", "_rn", "_before")
    )
