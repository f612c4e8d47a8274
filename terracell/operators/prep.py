"""Feature preparation: fill, scale, encode, transform, select.

``fit_*`` functions return a few numbers per column, read by one aggregate; applying them is a
projection. The split keeps test rows out of the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.operators import aggregates as agg
from terracell.operators import columns as cols
from terracell.operators import neighbours
from terracell.operators.ranking import column_quantiles, shuffled_position
from terracell.session import cut_lineage

BOXED_COLUMNS = 8


def fit_fill(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> dict[str, float]:
    """Fill value per column: mean in one pass, or the exact median from counted values."""
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    if strategy == "median":
        return {c: v[0] for c, v in column_quantiles(df, columns, [0.5]).items()} if columns else {}
    raise ValueError(f"unknown fill strategy: {strategy}")


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]


def add_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})


def fill(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items() if v is not None}
    )


def fill_stage(values: Mapping[str, float | None], indicators: Sequence[str], suffix: str = "__x") -> SQLTransformer:
    """Filled copies and missing indicators as a stage that is saved with its pipeline; a value of None fills nothing."""
    made = [f"cast(`{c}` AS double) AS `{c}{suffix}`" for c, v in values.items() if v is None]
    made += [f"coalesce(cast(`{c}` AS double), {float(v)!r}D) AS `{c}{suffix}`" for c, v in values.items() if v is not None]
    made += [f"cast(`{c}` IS NULL AS double) AS `{c}_missing`" for c in indicators]
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def scale_stage(scales: Mapping[str, Scale], suffix: str = "__x", output: str = "__z") -> SQLTransformer:
    made = [f"(`{c}{suffix}` - {float(s.centre)!r}D) / {float(s.width)!r}D AS `{c}{output}`" for c, s in scales.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")


def fill_categories(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.na.fill(value, subset=list(columns))


@dataclass(frozen=True)
class Scale:
    centre: float
    width: float

    def apply(self, c: Column) -> Column:
        return (c - F.lit(self.centre)) / F.lit(self.width)


def fit_scale(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict[str, Scale]:
    """Standard (population deviation), min-max, or robust (median and quartile range)."""
    if kind == "none":
        return {}
    if kind == "standard":
        row = df.agg(
            *[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"b_{c}") for c in columns]
        ).first()
        found = {c: (row[f"a_{c}"] or 0.0, row[f"b_{c}"]) for c in columns}
    elif kind == "minmax":
        row = df.agg(
            *[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]
        ).first()
        found = {c: (float(row[f"a_{c}"]), float(row[f"b_{c}"] - row[f"a_{c}"])) for c in columns}
    elif kind == "robust":
        quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        found = {
            c: (0.0, 1.0) if mid is None else (mid, high - low) for c, (low, mid, high) in quartiles.items()
        }
    else:
        raise ValueError(f"unknown scale: {kind}")
    return {c: Scale(a, b if b else 1.0) for c, (a, b) in found.items()}


def scale(df: DataFrame, scales: Mapping[str, Scale]) -> DataFrame:
    return df.withColumns({c: s.apply(F.col(c).cast("double")) for c, s in scales.items()})


def card_split(df: DataFrame, columns: Sequence[str], n: int = 11) -> tuple[list[str], list[str]]:
    """Categorical columns with at most n values, and the others."""
    counts = {r["column"]: r["n_distinct"] for r in agg.distinct_counts(df, list(columns)).collect()}
    low = [c for c in columns if counts.get(c, 0) <= n]
    return low, [c for c in columns if c not in low]


def one_hot_stages(columns: Sequence[str]) -> list:
    """Indexer and encoder; a value unseen in fitting gets the dropped last slot, all zeros."""
    if not columns:
        return []
    return [
        StringIndexer(
            inputCols=list(columns),
            outputCols=[f"{c}_index" for c in columns],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in columns],
            outputCols=[f"{c}_hot" for c in columns],
            dropLast=True,
        ),
    ]


def ordinal_stage(columns: Sequence[str], suffix: str = "_code") -> StringIndexer:
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[c + suffix for c in columns],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )


def feature_stages(df: DataFrame, columns: Sequence[str], max_card: int = 11, output: str = "features") -> list:
    """Stages by type: numbers as they are, few-valued text one-hot, other text ordinal."""
    numeric = [c for c in cols.numeric_columns(df, with_bool=True) if c in columns]
    texts = [c for c in columns if c not in numeric]
    low, high = card_split(df, texts, max_card) if texts else ([], [])
    stages = one_hot_stages(low)
    if high:
        stages.append(ordinal_stage(high))
    inputs = numeric + [f"{c}_hot" for c in low] + [f"{c}_code" for c in high]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")]


def log_target(df: DataFrame, target: str, name: str) -> DataFrame:
    """Natural log; zero or less has none and is flagged."""
    x = F.col(target)
    return df.withColumns({name: F.when(x > 0, F.ln(x)), f"{name}_undefined": x <= 0})


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.ln(x + 1) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    two = 2.0 - lam
    down = -F.ln(1 - x) if abs(two) < 1e-9 else -(F.pow(1 - x, F.lit(two)) - 1) / F.lit(two)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, lam: float) -> Column:
    up = F.exp(z) - 1 if abs(lam) < 1e-9 else F.pow(z * F.lit(lam) + 1, F.lit(1 / lam)) - 1
    two = 2.0 - lam
    down = 1 - F.exp(-z) if abs(two) < 1e-9 else 1 - F.pow(1 - z * F.lit(two), F.lit(1 / two))
    return F.when(z >= 0, up).otherwise(down)


@dataclass(frozen=True)
class PowerTarget:
    lam: float
    mean: float
    std: float

    def apply(self, x: Column) -> Column:
        return (yeo_johnson(x, self.lam) - F.lit(self.mean)) / F.lit(self.std)

    def invert(self, z: Column) -> Column:
        return yeo_johnson_inverse(z * F.lit(self.std) + F.lit(self.mean), self.lam)

    def invert_sql(self, name: str) -> str:
        """``invert`` as the text of a saved stage."""
        z, lam, two = f"({name} * {self.std!r}D + {self.mean!r}D)", self.lam, 2.0 - self.lam
        up = f"exp({z}) - 1" if abs(lam) < 1e-9 else f"power({z} * {lam!r}D + 1, {1 / lam!r}D) - 1"
        down = f"1 - exp(-{z})" if abs(two) < 1e-9 else f"1 - power(1 - {z} * {two!r}D, {1 / two!r}D)"
        return f"CASE WHEN {z} >= 0 THEN {up} ELSE {down} END"


def inverse_stage(expression: str, name: str = "prediction") -> SQLTransformer:
    """Puts a prediction back on the scale of its target."""
    return SQLTransformer(statement=f"SELECT * EXCEPT ({name}), {expression} AS {name} FROM __THIS__")


def fit_power(df: DataFrame, target: str) -> PowerTarget:
    """Yeo-Johnson lambda of highest likelihood, then mean and deviation.

    Three passes: a coarse grid, then two ten times finer ones around the best. Every pass scores
    its whole grid in one aggregate.
    """
    x = F.col(target).cast("double")
    best, step = 0.0, 0.2
    grid = [i * step for i in range(-15, 26)]
    for _ in range(3):
        row = df.agg(
            F.count(x).alias("n"),
            F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"),
            *[F.var_pop(yeo_johnson(x, lam)).alias(f"v{i}") for i, lam in enumerate(grid)],
        ).first()
        scored = [
            (-row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["j"], lam)
            for i, lam in enumerate(grid)
            if row[f"v{i}"] and row[f"v{i}"] > 0
        ]
        if not scored:
            return PowerTarget(1.0, df.agg(F.avg(x)).first()[0], 1.0)
        best = max(scored)[1]
        step /= 10
        grid = [best + i * step for i in range(-10, 11)]
    row = df.agg(F.avg(yeo_johnson(x, best)).alias("m"), F.stddev_pop(yeo_johnson(x, best)).alias("s")).first()
    return PowerTarget(best, row["m"], row["s"] or 1.0)


def knn_values(
    asks: DataFrame, donors: DataFrame, columns: Sequence[str], key: str = "hex_code", k: int = 5, block_rows: int = 2048
) -> DataFrame:
    """(key, _f_<column>...): the mean of the k nearest donors for each missing value, by distance over the shared columns.

    Exact for any size and skew. Up to ``BOXED_COLUMNS`` columns, a row only meets the boxes of donors that may hold
    one of the nearest (``neighbours.nearest``). With more columns, or hundreds of sets of missing ones, rows are dealt to even
    hash blocks and every block of incomplete rows meets every block of donors in one task of bounded size. A task sends on
    only its k best donors per missing value, never the pairs; of these the k best are kept by a ranking that is limited
    before it is shuffled. Equal distances are taken in the order of the donors' values. Distances scale for missing
    columns as sum * (all columns / shared columns). A value that no donor shares a column with stays null.
    """
    names = list(columns)
    asks = asks.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in names], F.lit(0)) == 1)
    near = neighbours.nearest(asks, donors, names, key, k, max(1, block_rows // 4)) if len(names) <= BOXED_COLUMNS else None
    if near is None:
        near = block_candidates(asks, donors, names, key, k, block_rows)
    order = Window.partitionBy(key, "col").orderBy("dist", "value")
    top = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k)
    return top.groupBy(key).agg(*[F.avg(F.when(F.col("col") == i, F.col("value"))).alias(f"_f_{c}") for i, c in enumerate(names)])


def block_candidates(asks: DataFrame, donors: DataFrame, names: list[str], key: str, k: int, block_rows: int) -> DataFrame:
    """``(key, col, dist, value)``: k nearest donors of every block of donors."""
    import numpy as np
    import pandas as pd

    kind = dict(asks.dtypes)[key]
    schema = f"`{key}` {kind}, col int, dist double, value double"

    def blocks_of(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select(key, *[F.col(c).cast("double").alias(c) for c in names], block, every).groupBy("_ask", "_give")

    n_asks, n_gives = blocks_of(asks), blocks_of(donors)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({key: left[key][:0], "col": [], "dist": [], "value": []})
        if left.empty or right.empty:
            return none
        a, b = left[names].to_numpy(float), right[names].to_numpy(float)
        ma, mb = ~np.isnan(a), ~np.isnan(b)
        a0, b0 = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
        shared = ma.astype(float) @ mb.T.astype(float)
        sq = (a0**2) @ mb.T - 2 * a0 @ b0.T + ma @ (b0**2).T
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.where(shared > 0, np.maximum(sq, 0.0) * len(names) / shared, np.nan)
        same = left[key].to_numpy()[:, None] == right[key].to_numpy()[None, :]
        dist = np.where(same, np.nan, dist)
        parts = []
        for j in range(len(names)):
            rows, givers = np.flatnonzero(~ma[:, j]), np.flatnonzero(mb[:, j])
            if not len(rows) or not len(givers):
                continue
            givers = givers[np.argsort(b[givers, j], kind="stable")]  # so that equal distances come in the order of values
            d = dist[np.ix_(rows, givers)]
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            flat = np.take_along_axis(d, top, axis=1)
            own = np.repeat(left[key].to_numpy()[rows], top.shape[1])
            parts.append(pd.DataFrame({key: own, "col": j, "dist": flat.ravel(), "value": b[givers[top.ravel()], j]}))
        return pd.concat(parts).dropna(subset=["dist"]) if parts else none

    left = dealt(asks, "_ask", n_asks, "_give", n_gives)
    right = dealt(donors, "_give", n_gives, "_ask", n_asks)
    return left.cogroup(right).applyInPandas(best, schema)


def shadow_columns(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """Each feature with a shuffled twin: row i takes the values of the row at its shuffled place."""
    a = shuffled_position(df, [key], seed=seed, name="_a")
    b = shuffled_position(df.select(key, *columns), [key], seed=seed + 7919, name="_a")
    return a.join(b.select("_a", *[F.col(c).alias(f"shadow_{c}") for c in columns]), "_a").drop("_a")


def _binomial_tail(hits: int, n: int) -> float:
    return sum(math.comb(n, i) for i in range(hits, n + 1)) / 2**n


def select_features(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    key: str = "hex_code",
    n_trials: int | None = None,
    p_value: float = 0.05,
    estimator: Estimator | None = None,
    seed: int = 42,
) -> dict[str, list[str]]:
    """Features that beat the best shuffled twin more often than chance.

    Returns accepted, tentative and rejected names (one-sided binomial test, corrected for the
    number of features). By default there are five trials more than the test needs to tell anything.
    The rows are stored once, and each trial's shuffled twins are made once for all passes of its fit.
    """
    least = math.floor(math.log2(len(columns) / p_value)) + 1
    n_trials = least + 5 if n_trials is None else n_trials
    if n_trials < least:
        raise ValueError(f"{n_trials} trials can't accept one of {len(columns)} features; take {least} or more")
    rows = cut_lineage(df.select(key, *columns, target).na.drop())
    hits = dict.fromkeys(columns, 0)
    for trial in range(n_trials):
        both = shadow_columns(rows, columns, key, seed + trial)
        names = [*columns, *[f"shadow_{c}" for c in columns]]
        vec = cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(both))
        est = estimator or RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed + trial)
        est = est.copy({est.labelCol: target, est.featuresCol: "features"})
        gain = est.fit(vec).featureImportances.toArray()
        bar = max(gain[len(columns) :])
        for c, g in zip(columns, gain[: len(columns)], strict=True):
            hits[c] += int(g > bar)
    level = p_value / len(columns)
    out: dict[str, list[str]] = {"accepted": [], "tentative": [], "rejected": []}
    for c in columns:
        if _binomial_tail(hits[c], n_trials) < level:
            out["accepted"].append(c)
        elif _binomial_tail(n_trials - hits[c], n_trials) < level:
            out["rejected"].append(c)
        else:
            out["tentative"].append(c)
    return out


def pipeline(stages: Sequence) -> Pipeline:
    return Pipeline(stages=list(stages))


