"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key -ln(u) / quality, u from a hash of id and text. A source's
target is cut into complete epochs (every document that many times) and a remainder, which takes the
documents of smallest keys until their sizes reach it.

Nothing is sorted as a whole: ranges of the keys' logarithms are summed (pre-aggregated), from the least to
the largest of each source, so the same choice follows from qualities of any scale. Only the range in which
the remainder ends is cut again and then ordered. What comes back is one threshold per source,
so the last pass over the documents is a map. Thresholds are broadcast only up to
``BROADCAST_SOURCES`` sources, else they are joined by a shuffle that can split a hot source.

Defined results: a null text has size 0; null is a source of its own and comes last; a document of
size 0 is taken as often as others and adds no words; quality must be positive, null and NaN count as 1
and values below 1e-300 as 1e-300. Rows of equal id, text and quality have equal keys; where the remainder
ends among such rows, as many of them go in as fit, by ranges of a hash of their columns. An empty
table gives no rows. The document at the end of the remainder goes in when half of it or more fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import WORD, fresh, replace_columns, stored, whole

BROADCAST_SOURCES = 10_000
RANGES = 4096
#: Least weight of a document.
LEAST_QUALITY = 1e-300
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def symbol_quality(text: Column) -> Column:
    """From 0.5 (many symbols) to 1 (none)."""
    share = F.regexp_count(text, F.lit("[#*$%&|<>]")) * 20.0 / F.greatest(F.length(text), F.lit(1))
    return 1.0 - 0.5 * F.least(share, F.lit(1.0))


def place(doc: Column, quality: Column, seed: int) -> Column:
    """Logarithm of the exponential key -ln(u) / quality, small keys first."""
    u = (F.shiftrightunsigned(F.xxhash64(doc, F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    q = F.coalesce(F.nanvl(quality.cast("double"), F.lit(1.0)), F.lit(1.0))
    return F.log(-F.log(u)) - F.log(F.greatest(q, F.lit(LEAST_QUALITY)))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): min(most * size, level * weight) with one level.

    Handing the excess of full sources to the others by weight ends at this level. Sources by
    rising size per weight: the first one that its level doesn't fill fixes the level for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    s = s.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    )
    s = s.withColumn("at", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level")))
    level = F.coalesce(first.over(everything)["level"], F.lit(float("inf")))
    target = F.least("cap", level * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def by_source(df: DataFrame, per_source: DataFrame, n_sources: int, key: str) -> DataFrame:
    """Joins one row per source; broadcast behind the check of its size."""
    of = fresh(df, "of_source")
    right = per_source.withColumnRenamed("source", of)
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return df.join(right, F.col(key).eqNullSafe(F.col(of)), "left").drop(of)


def refined(rows: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """Narrows each source's (low, high, rest) to the range in which the rest runs out."""
    width = (F.col("high") - F.col("low")) / RANGES
    at = F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(RANGES - 1))
    inside = by_source(rows, state, n_sources, "source").where("x >= low and x < high")
    sums = inside.groupBy("source", "low", "high", "rest", at.alias("r")).agg(F.sum("size").alias("s"))
    sums = sums.withColumn("end", F.sum("s").over(Window.partitionBy("source").orderBy("r")))
    # the first range that passes the rest; where none does, an empty range above all
    hit = F.min(F.when(F.col("end") > F.col("rest"), F.struct("r", "end", "s")))
    cut = sums.groupBy("source", "low", "high", "rest").agg(hit.alias("hit"))
    step = (F.col("high") - F.col("low")) / RANGES
    return cut.select(
        "source",
        F.coalesce(F.col("low") + F.col("hit.r") * step, F.col("high")).alias("low"),
        F.when(F.col("hit.r") == RANGES - 1, F.col("high"))
        .otherwise(F.coalesce(F.col("low") + (F.col("hit.r") + 1) * step, F.col("high")))
        .alias("high"),
        F.coalesce(F.col("rest") - (F.col("hit.end") - F.col("hit.s")), F.lit(0.0)).alias("rest"),
    )


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = SOURCE_WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    quality: Column | None = None,
    seed: int = 7,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``df`` with size, source_size, target, times (int) and taken = times * size."""
    df = replace_columns(df, ["size", "source_size", "target", "times", "taken"])
    t = whole(text_col)
    quality = symbol_quality(t) if quality is None else quality
    doc, x, src = F.xxhash64(F.col(id_col), t), fresh(df, "x"), F.col(source_col)
    sized = df.withColumns({"size": n_words(t), x: place(doc, quality, seed)})
    rows = stored(sized.select(src.alias("source"), F.col(x).alias("x"), "size"))

    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("x").alias("low"), (F.max("x") + 1e-6).alias("high")
    )
    sizes = stored(sizes)
    n_sources = sizes.count()
    plan = targets(sizes.drop("low", "high"), weights, share, most).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    state = by_source(sizes.select("source", "low", "high"), plan.select("source", "rest"), n_sources, "source")
    for _ in range(2):
        state = stored(refined(rows, state, n_sources))
    last = by_source(rows, state, n_sources, "source").where("x >= low and x < high")
    last = last.groupBy("source", "x", "rest").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    last = last.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("x")) - F.col("s"))
    # of n equal rows as many as fit, the last one when half of it does
    room = F.col("rest") - F.col("before")
    fit = F.when(F.col("s") > 0, F.least(F.col("n"), F.floor(room * F.col("n") / F.col("s") + 0.5)))
    last = last.withColumn("fit", F.coalesce(fit, F.when(room >= 0, F.col("n"))))
    found = F.max(F.struct("x", "fit", "n"))
    edge = last.where("fit > 0").groupBy("source").agg(found.alias("edge"))
    edge = edge.select("source", F.col("edge.x").alias("edge"), F.col("edge.fit").alias("fit"), F.col("edge.n").alias("n"))
    plan = by_source(plan, state.select("source", "low"), n_sources, "source")
    plan = by_source(plan, edge, n_sources, "source").select(
        "source", "source_size", "target", "epochs", "rest", "low", "edge", "fit", (F.col("fit") < F.col("n")).alias("part")
    )
    plan = stored(plan)

    names = {c: fresh(df, f"plan_{c}") for c in ("epochs", "rest", "low", "edge", "fit", "part")}
    result = [*df.columns, "size", "source_size", "target", "times", "taken"]
    out = by_source(sized, plan.withColumnsRenamed(names), n_sources, source_col)
    epochs, rest, low, edge, fit, part = (F.col(c) for c in names.values())

    def taken(rows: DataFrame, chosen: Column) -> DataFrame:
        rows = rows.withColumn("times", (epochs + F.when(chosen, 1).otherwise(0)).cast("int"))
        return rows.withColumn("taken", F.col("times") * F.col("size")).select(*result)

    chosen = (rest > 0) & ((F.col(x) < low) | (F.col(x) <= edge))
    if plan.where("rest > 0 and part").isEmpty():
        return taken(out, chosen)
    # some source ends among equal rows: these get numbers, all others pass as before
    at_edge = F.coalesce((rest > 0) & part & (F.col(x) == edge), F.lit(False))
    number = fresh(out, "number")
    equal = numbered_in(out.where(at_edge), source_col, number)
    return taken(out.where(~at_edge), chosen).unionByName(taken(equal, F.col(number) <= fit))


def numbered_in(rows: DataFrame, source_col: str, number: str) -> DataFrame:
    """``rows`` numbered from 1 in each source, by ranges of a hash of all columns.

    Rows may all be equal, so the ranges are cut again by the partitions of the stored rows. These are
    numbered within, and shifted by the sizes of those before.
    """
    of, salt, digest, start = (fresh(rows, c) for c in ("of", "salt", "digest", "start"))
    hashed = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in rows.columns])
    kept = rows.withColumns({of: F.col(source_col), digest: hashed})
    kept = stored(kept.withColumn(salt, F.struct(F.shiftright(digest, 54).alias("r"), F.spark_partition_id().alias("p"))))
    counts = kept.groupBy(of, salt).count()
    before = Window.partitionBy(of).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("count").over(before), F.lit(0))
    starts = stored(counts.select(F.col(of).alias(of + "2"), F.col(salt).alias(salt + "2"), shift.alias(start)))
    rank = F.row_number().over(Window.partitionBy(of, salt).orderBy(digest))
    met = kept.withColumn(number, rank).join(
        starts, F.col(of).eqNullSafe(F.col(of + "2")) & (F.col(salt) == F.col(salt + "2"))
    )
    return met.withColumn(number, F.col(number) + F.col(start)).select(*rows.columns, number)


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``df``."""
    out = mix(df, **options).where("times > 0")
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*df.columns)
