"""Prediction intervals from absolute residuals (split conformal)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.operators.ranking import value_at_rank, value_positions

UNCLIPPED = ("sumpoor_sev",)


def require_fitted(model) -> PipelineModel:
    if not isinstance(model, PipelineModel):
        raise TypeError("intervals need a fitted pipeline")
    return model


def residuals(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Absolute residuals of the rows that have a truth."""
    return df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(
        F.abs(F.col(truth) - F.col(pred)).alias("residual")
    )


def calibrate(df: DataFrame, truth: str, pred: str, alpha: float = 0.05) -> DataFrame:
    """One row ``width``: the residual at rank ceil((n+1)(1-alpha)), at most n.

    The rank is found among counted residuals by running sums over value ranges, so no task
    orders all residuals.
    """
    res = residuals(df, truth, pred)
    n = res.agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)), n)
    found = value_at_rank(value_positions(res, "residual"), "residual", rank)
    return found.agg(F.max("residual").alias("width"))


def clip_unit(column: Column, target: str) -> Column:
    """Clip to [0, 1], except for the deprivation total."""
    if target in UNCLIPPED:
        return column
    return F.greatest(F.least(column, F.lit(1.0)), F.lit(0.0))


def predict_intervals(df: DataFrame, width: DataFrame, pred: str, target: str = "", suffix: str = "") -> DataFrame:
    """``lower, prediction, upper`` beside the input; map-only, the width is a scalar subquery."""
    w = width.select("width").scalar()
    p = F.col(pred)
    return df.withColumns(
        {
            f"lower{suffix}": clip_unit(p - w, target),
            f"prediction{suffix}": p,
            f"upper{suffix}": clip_unit(p + w, target),
        }
    )


def width_stats(df: DataFrame, suffix: str = "") -> DataFrame:
    width = F.col(f"upper{suffix}") - F.col(f"lower{suffix}")
    return df.agg(
        F.avg(width).alias("mean_width"), F.min(width).alias("min_width"), F.max(width).alias("max_width")
    )


def coverage(df: DataFrame, truth: str, suffix: str = "") -> DataFrame:
    hit = F.col(truth).between(F.col(f"lower{suffix}"), F.col(f"upper{suffix}"))
    return df.agg(F.avg(hit.cast("double")).alias("coverage"))
