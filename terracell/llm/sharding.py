"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a number 0..n-1: equal rows are counted (pre-aggregated) and cut into lots of bounded size, lots
are dealt into even buckets by a hash, numbered inside the bucket and shifted by the sizes of the buckets
before. A keyed permutation of 0..n-1 turns the
number into a place; ``place % shards`` is the shard and ``place // shards`` the slot, so any place
can be computed without the data, sizes differ by one row at most and slots have no gap.

The permutation works on ``a * b >= n`` pairs with ``a`` and ``b`` near the root of ``n`` and walks on
from places of n and above. Fewer than ``a`` places are above n, which bounds a walk.

Defined results: ids may be null or repeat; rows of one id are numbered by text size and checksum,
and rows that are equal in all of these are interchangeable. A null text has no bytes. Empty tables
give no rows. Only narrow rows (id, size, checksum) are shuffled; hot sources or texts and rows repeated
any number of times do not matter, as no lot has more than ``LOT`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import fresh, stored, whole

ROUNDS = 6
ROWS_A_BUCKET = 50_000
#: Equal rows that are dealt out together.
LOT = 10_000


def numbered(df: DataFrame, number: str) -> tuple[DataFrame, int]:
    """``df`` with a global row number in the order of (hash bucket, columns), and the row count.

    Equal rows are counted before anything is dealt out. The running sum of bucket sizes is taken in
    two levels, so no task sees all buckets of a large table.
    """
    keys = df.columns
    b, times, lot, start = (fresh(df, c) for c in ("bucket", "times", "lot", "start"))
    counted = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(times)))
    n = counted.agg(F.sum(times)).first()[0] or 0
    buckets = max(1, -(-n // ROWS_A_BUCKET))
    lots = counted.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(LOT).cast("long"))))
    lots = lots.withColumn(times, F.least(F.col(times) - F.col(lot), F.lit(LOT)))
    dealt = lots.withColumn(b, F.pmod(F.xxhash64(*keys, lot), F.lit(buckets)))
    sizes = dealt.groupBy(b).agg(F.sum(times).alias("n_in"))
    sizes = stored(sizes).withColumn("upper", F.floor(F.col(b) / 1024))
    uppers = sizes.groupBy("upper").agg(F.sum("n_in").alias("n_upper"))
    order = Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    uppers = uppers.select("upper", F.coalesce(F.sum("n_upper").over(order), F.lit(0)).alias("first_upper"))
    inside = Window.partitionBy("upper").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(uppers, "upper").select(
        b, (F.col("first_upper") + F.coalesce(F.sum("n_in").over(inside), F.lit(0))).alias(start)
    )
    before = Window.partitionBy(b).orderBy(*keys, lot).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(number, F.coalesce(F.sum(times).over(before), F.lit(0))).join(starts, b)
    first = F.col(start) + F.col(number)
    return out.select(*keys, F.explode(F.sequence(first, first + F.col(times) - 1)).alias(number)), n


def feistel(x: Column, a: int, b: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of 0..a*b-1: halves of unlike size take turns in shifting each other."""
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
    pair = F.struct(left.alias("l"), right.alias("r"))
    for i in range(rounds):
        if i % 2:
            move = lambda p, i=i: F.struct(
                p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], F.lit(seed), F.lit(i)), F.lit(b)), F.lit(b)).alias("r")
            )
        else:
            move = lambda p, i=i: F.struct(
                F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(seed), F.lit(i)), F.lit(a)), F.lit(a)).alias("l"), p["r"].alias("r")
            )
        pair = F.get(F.transform(F.array(pair), move), F.lit(0))
    return F.get(F.transform(F.array(pair), lambda p: p["l"] * F.lit(b) + p["r"]), F.lit(0))


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row number ``x`` among ``n``: Feistel steps until the value is below n."""
    if n < 2:
        return x
    b = math.isqrt(n - 1) + 1
    a = -(-n // b)
    above = a * b - n
    once = F.get(F.transform(F.array(x), lambda v: feistel(v, a, b, seed)), F.lit(0))
    if not above:
        return once
    walk = lambda v: F.when(v < n, v).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.lit(above)),
            v,
            lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, seed)),
        )
    )
    return F.get(F.transform(F.array(once), walk), F.lit(0))


def shard(
    df: DataFrame, shards: int = 16, seed: int = 17, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, size, text_crc32, place, shard, slot) of every row."""
    t = whole(text_col)
    narrow = df.select(
        F.col(id_col),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    out, n = numbered(narrow, "row_number")
    out = out.withColumn("place", permuted(F.col("row_number"), n, seed)).drop("row_number")
    return out.withColumns(
        {
            "shard": F.pmod("place", F.lit(shards)).cast("int"),
            "slot": F.floor(F.col("place") / F.lit(shards)).cast("long"),
        }
    )
