"""Aggregations per cell and per table. Each is one grouped pass with map-side partials."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import columns as cols
from terracell.operators.ranking import value_positions

CELL = "hex_code"


def _number(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if dict(df.dtypes)[c] == "boolean" else F.col(c)


def mean_by_cell(df: DataFrame, cell: str = CELL, count_of: str = "survey") -> DataFrame:
    """Mean of every numeric or flag column and the non-null count of one, in one pass."""
    values = [c for c in cols.numeric_columns(df, with_bool=True) if c != cell]
    return df.groupBy(cell).agg(
        F.count(count_of).alias(count_of),
        *[F.avg(_number(df, c)).alias(c) for c in values if c != count_of],
    )


def at_least(df: DataFrame, count: str, threshold: int) -> DataFrame:
    return df.filter(F.col(count) >= threshold)


def spread_to_neighbours(
    df: DataFrame, cell: str = CELL, location: str = "location"
) -> DataFrame:
    """Means and counts after copying each answer over the disk it may have come from.

    Rows are first reduced to sums and counts per (cell, urban or not); only those go through the
    7x or 19x explode, so the copy cost follows cells and not people.
    """
    values = [c for c in cols.numeric_columns(df, with_bool=True) if c != cell]
    urban = F.coalesce(F.col(location) == 1, F.lit(False))
    partial = [F.sum(_number(df, c).cast("double")).alias(f"_s_{c}") for c in values]
    partial += [F.count(c).alias(f"_n_{c}") for c in values]
    small = df.groupBy(cell, urban.alias("_urban")).agg(*partial)
    reach = F.when(F.col("_urban"), grid.disk(cell, 1)).otherwise(grid.disk(cell, 2))
    copied = small.withColumn("_to", F.explode(reach))
    sums = copied.groupBy(F.col("_to").alias(cell)).agg(
        *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in values],
        *[F.sum(f"_n_{c}").alias(f"_n_{c}") for c in values],
    )
    out = [F.try_divide(F.col(f"_s_{c}"), F.col(f"_n_{c}")).alias(f"{c}_mean") for c in values]
    out += [F.col(f"_n_{c}").alias(f"{c}_count") for c in values if c.endswith("_sev")]
    return sums.select(cell, *out)


def aggregate_hexagon(df: DataFrame, column: str, name: str, kind: str, cell: str = CELL) -> DataFrame:
    """Count or mean of one column per cell under a new name."""
    how = F.count(column) if kind == "count" else F.avg(column)
    return df.groupBy(cell).agg(how.alias(name))


def aggregate_mixed(df: DataFrame, how: Mapping[str, str | Callable], cell: str = CELL) -> DataFrame:
    """A dict of column to aggregate: a Spark function name or any ``Column -> Column``."""
    def one(c: str, fn: str | Callable) -> Column:
        made = getattr(F, fn)(c) if isinstance(fn, str) else fn(F.col(c))
        return made.alias(c)

    return df.groupBy(cell).agg(*[one(c, fn) for c, fn in how.items()])


def density_per_cell(df: DataFrame, length: str, res: int, name: str = "length_km", cell: str = CELL) -> DataFrame:
    """Length in metres summed per cell, in km and in km per km2."""
    total = df.groupBy(cell).agg((F.sum(length) / F.lit(1000.0)).alias(name))
    return total.withColumn("road_density", F.col(name) / F.lit(grid.CELL_AREA_KM2[res]))


def left_zero(base: DataFrame, other: DataFrame, on: str = CELL) -> DataFrame:
    """Left join whose missing right side means zero."""
    added = [c for c in other.columns if c != on]
    return base.join(other, on, "left").na.fill(0, subset=added)


def category_counts(
    df: DataFrame,
    category: str,
    values: Sequence[str],
    extra: Mapping[str, Column] | None = None,
    cell: str = CELL,
) -> DataFrame:
    """One count column per category and further aggregates, in the same shuffle."""
    counts = [F.count_if(F.col(category) == v).alias(v) for v in values]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return df.groupBy(cell).agg(*counts, *more)


def missing_counts(df: DataFrame, above: int = -1, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, as rows."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "missing").filter(F.col("missing") > above)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, as rows.

    Values are shuffled by (column, value), so one long column does not sit in one task.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
        ).alias("p")
    ).select("p.*")
    seen = pairs.filter("v IS NOT NULL").distinct()
    return seen.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def row_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def deprivation_index(df: DataFrame, dims: Sequence[str], total: str = "sumpoor_sev") -> DataFrame:
    """Total over the number of dimensions answered; null when none was."""
    answered = F.lit(len(dims)) - row_missing(df, dims)
    return df.withColumn("dep_sev_idx", F.try_divide(F.col(total), answered))


def share_where(df: DataFrame, predicates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows satisfying each predicate; a missing comparison counts as no."""
    return df.groupBy(*by).agg(
        *[F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias(n) for n, p in predicates.items()]
    )


def threshold_loss(counts: DataFrame, count: str, cuts: Sequence[int] = (5, 10, 15, 20, 30)) -> DataFrame:
    """Share of cells lost below each sample-size cut."""
    wide = counts.agg(*[F.avg((F.col(count) < c).cast("double")).alias(str(c)) for c in cuts])
    long = wide.unpivot([], [str(c) for c in cuts], "cut", "share_lost")
    return long.select(F.col("cut").cast("int").alias("cut"), "share_lost")


def quantile(df: DataFrame, column: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact interpolated quantile from counted values: the two neighbours of the position."""
    pos = value_positions(df, column)
    total = df.select(F.count(column).alias("n")).scalar()
    at = F.lit(q) * (total - 1)
    low, high = F.floor(at) + 1, F.ceil(at) + 1

    def stands(rank: Column) -> Column:
        return (F.col("below") < rank) & (rank <= F.col("below") + F.col("ties"))

    picked = pos.agg(
        F.max(F.when(stands(low), F.col(column))).alias("lo"),
        F.max(F.when(stands(high), F.col(column))).alias("hi"),
    )
    return picked.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias(name))


def extents(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, min and max per column, as rows, in one pass."""
    stats = {
        "count": F.count,
        "mean": F.avg,
        "stddev": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    wide = df.agg(
        *[f(c).cast("double").alias(f"{c}__{n}") for c in columns for n, f in stats.items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in stats])
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin, empty bins are listed."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo = F.lit(low) if low is not None else ends.select("lo").scalar()
    hi = F.lit(high) if high is not None else ends.select("hi").scalar()
    x = F.col(column).cast("double")
    slot = F.floor(F.try_divide((x - lo) * F.lit(bins), hi - lo))
    slot = F.when(x == hi, bins - 1).otherwise(slot).cast("int")
    inside = df.filter(x.between(lo, hi)).groupBy(F.coalesce(slot, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(inside, "bin", "left").na.fill(0, subset=["n"])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are known, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(
        *[
            F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.inline(rows))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        list(ids), list(values), name, value
    )


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by a stated order.

    ``min_by`` over a struct instead of a row-number window: copies of a hot key collapse before
    the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*df.columns)


def group_features(
    df: DataFrame, group: str, category: str, values: Sequence, numeric: Sequence[str]
) -> DataFrame:
    """Per group, category value and numeric column: mean, std, min, max and skew.

    Skewness is the bias-corrected sample form, null below three rows.
    """
    out = []
    for v in values:
        hit = F.col(category) == F.lit(v)
        for c in numeric:
            x = F.when(hit, F.col(c))
            n = F.count(x).cast("double")
            fix = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
            name = f"{c}_{category}_{v}"
            out += [
                F.avg(x).alias(f"{name}_mean"),
                F.stddev_samp(x).alias(f"{name}_std"),
                F.min(x).alias(f"{name}_min"),
                F.max(x).alias(f"{name}_max"),
                F.when(n >= 3, F.skewness(x) * fix).alias(f"{name}_skew"),
            ]
    return df.groupBy(group).agg(*out)


def weighted_neighbour_mean(cells: DataFrame, value: str, weight: str, k: int, name: str, cell: str = CELL) -> DataFrame:
    """Weighted mean of a value over each cell's disk; every cell is sent to its k-disk once."""
    sent = cells.select(
        F.explode(grid.disk(cell, k)).alias(cell),
        (F.col(weight) * F.col(value)).alias("_wx"),
        F.when(F.col(value).isNotNull(), F.col(weight)).alias("_w"),
    )
    sums = sent.groupBy(cell).agg(F.try_divide(F.sum("_wx"), F.sum("_w")).alias(name))
    return cells.select(cell).join(sums, cell)


def share_of_total(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """Value over its group's sum. The totals are a small aggregate joined back, so a hot group
    is never one task's window."""
    totals = df.groupBy(by).agg(F.sum(value).alias("_total"))
    return df.join(totals, by).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def neighbour_lists(cells: DataFrame, k: int, value: str, cell: str = CELL) -> DataFrame:
    """Sorted list of the values found in each cell's ring; at most one entry per ring cell."""
    sent = cells.select(
        F.explode(F.filter(grid.disk(cell, k), lambda c: c != F.col(cell))).alias(cell), F.col(value).alias("_v")
    )
    lists = sent.groupBy(cell).agg(F.array_sort(F.collect_list("_v")).alias("values"))
    return cells.select(cell).join(lists, cell)
