"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def to_least(pairs: DataFrame, over: str) -> DataFrame:
    """Each neighbour and each node itself points to the least node around ``a``.

    The minimum is pre-aggregated; the join deals out both sides, so a node with very many
    neighbours can be split.
    """
    least = written(pairs.groupBy("a").agg(F.min("b").alias("m")), "graph")
    least = least.select("a", F.least("a", "m").alias("m"))
    met = pairs.join(least, "a")
    if over == "large":
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    ``edges`` has long columns a and b; repeated edges and loops change nothing. The rounds grow with
    the logarithm of the longest chain, each is cut by a written table: a checkpoint keeps what the planner knows
    of its columns, and that grows from round to round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "graph")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    was = None
    while (state := now.agg(mark.alias("m")).first()["m"]) != was:
        was = state
        large = written(to_least(both_ways(now), "large"), "graph")
        now = written(to_least(large, "small"), "graph")
    tips = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tips.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
