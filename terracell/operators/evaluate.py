"""Scores, validation against areas, and set reconciliation. Every score is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.util import as_col
from terracell.operators import aggregates as agg
from terracell.operators.ranking import average_rank
from terracell.operators.spatial import points_in_areas


def _pair(truth, pred) -> tuple[Column, Column]:
    t, p = as_col(truth).cast("double"), as_col(pred).cast("double")
    both = t.isNotNull() & p.isNotNull()
    return F.when(both, t), F.when(both, p)


def mae(truth, pred) -> Column:
    t, p = _pair(truth, pred)
    return F.avg(F.abs(t - p))


def mse(truth, pred) -> Column:
    t, p = _pair(truth, pred)
    return F.avg((t - p) * (t - p))


def rmse(truth, pred) -> Column:
    return F.sqrt(mse(truth, pred))


def r2(truth, pred) -> Column:
    """1 - residual over total sum of squares; null when the truth is constant."""
    t, p = _pair(truth, pred)
    total = F.var_pop(t) * F.count(t)
    return F.when(F.var_pop(t) > 0, F.lit(1.0) - F.sum((t - p) * (t - p)) / total)


def weighted_scores(truth, pred, weight) -> dict[str, Column]:
    t, p = _pair(truth, pred)
    w = F.when(t.isNotNull(), as_col(weight).cast("double"))
    sw, swt, swtt = F.sum(w), F.sum(w * t), F.sum(w * t * t)
    rss = F.sum(w * (t - p) * (t - p))
    total = swtt - swt * swt / sw
    return {
        "r2": F.when(total > 0, F.lit(1.0) - rss / total),
        "rmse": F.sqrt(rss / sw),
        "mae": F.sum(w * F.abs(t - p)) / sw,
    }


def adjusted_r2(r2_col: Column, n: Column, p: int) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - r2_col) * F.try_divide(n - 1, n - p - 1)


def score(
    df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), n_features: int | None = None
) -> DataFrame:
    t, _ = _pair(truth, pred)
    out = [
        F.count(t).alias("n"),
        r2(truth, pred).alias("r2"),
        rmse(truth, pred).alias("rmse"),
        mae(truth, pred).alias("mae"),
    ]
    if n_features is not None:
        out.append(adjusted_r2(r2(truth, pred), F.count(t), n_features).alias("adjusted_r2"))
    return df.groupBy(*by).agg(*out)


def score_with_without(df: DataFrame, truth: str, pred: str, weight: str, group: str, name: str) -> DataFrame:
    """Plain and weighted scores over all rows and without one named group, from one scan."""
    keep_rest = F.col(group).isNull() | (F.col(group) != name)
    rows = df.select(
        F.explode(
            F.when(keep_rest, F.array(F.lit("all"), F.lit(f"without {name}"))).otherwise(F.array(F.lit("all")))
        ).alias("rows"),
        truth,
        pred,
        weight,
    )
    weighted = weighted_scores(truth, pred, weight)
    return rows.groupBy("rows").agg(
        r2(truth, pred).alias("r2"),
        rmse(truth, pred).alias("rmse"),
        mae(truth, pred).alias("mae"),
        *[c.alias(f"weighted_{n}") for n, c in weighted.items()],
    )


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    x, y = _pair(a, b)
    return df.groupBy(*by).agg(F.corr(x, y).alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with ties averaged; rows missing either value are left out."""
    both = df.select(a, b).na.drop()
    ranked = average_rank(average_rank(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the counted pairs.

    Every pair row tells its label class about truth and its predicted class about predictions, so
    the report needs no join.
    """
    told = confusion(df, label, pred).select(
        F.inline(
            F.array(
                F.struct(
                    F.col(label).alias("class"),
                    F.col("n").alias("truth"),
                    F.lit(0).cast("long").alias("said"),
                    F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col(pred).alias("class"),
                    F.lit(0).cast("long").alias("truth"),
                    F.col("n").alias("said"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        )
    )
    sums = told.groupBy("class").agg(
        F.sum("truth").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    p = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return sums.select(
        "class",
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
        "support",
    )


def micro_f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    """With one label per row, micro F1 is the share of exact hits."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("micro_f1"))


def floor_r2(column: Column | str) -> Column:
    return F.greatest(as_col(column), F.lit(0.0))


def area_validation(
    preds: DataFrame,
    areas: DataFrame,
    area_key: str,
    targets: Sequence[str],
    population: str = "population",
) -> DataFrame:
    """Predicted area figures: plain mean and population-share-weighted sum per target.

    A weighted sum of shares is sum(pop * x) / sum(pop), so the group share needs no window: both
    sums fall out of the one aggregate by area.
    """
    placed = points_in_areas(preds, areas, area_key)
    pop = F.col(population)
    out = [F.sum(pop).alias(population)]
    for t in targets:
        out += [
            F.avg(t).alias(t),
            F.try_divide(F.sum(pop * F.col(t)), F.sum(pop)).alias(f"{t}_pop_adj"),
        ]
    return placed.groupBy(area_key).agg(*out)


def reconcile(a: DataFrame, b: DataFrame, name_a: str, name_b: str, key: str = "hex_code") -> DataFrame:
    """How many keys stand in one set only and in both, from one tagged union."""
    tagged = a.select(key, F.lit(1).alias("_t")).unionByName(b.select(key, F.lit(2).alias("_t")))
    seen = tagged.groupBy(key).agg(F.bit_or("_t").alias("_m"))
    counts = seen.agg(
        F.count_if(F.col("_m") == 1).alias(f"{name_a}_only"),
        F.count_if(F.col("_m") == 2).alias(f"{name_b}_only"),
        F.count_if(F.col("_m") == 3).alias("both"),
    )
    return counts.unpivot([], [f"{name_a}_only", f"{name_b}_only", "both"], "side", "n")


def compare_with_index(preds: DataFrame, index: DataFrame, columns: Sequence[str], value: str, key: str = "hex_code") -> DataFrame:
    """Correlation of each prediction column with an outside index over shared cells."""
    joined = preds.join(index.select(key, value), key)
    wide = joined.agg(*[F.corr(c, value).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "corr")


def country_means(scores: DataFrame, value: str = "r2") -> DataFrame:
    return scores.groupBy("country", "target").agg(F.avg(floor_r2(value)).alias(value))


def missing_above(df: DataFrame, n: int) -> DataFrame:
    return agg.missing_counts(df, above=n)
