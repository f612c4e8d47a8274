"""Prediction and interval jobs over all cells of a country."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import conformal, models
from terracell.operators.columns import other_columns
from terracell.operators.prep import fill_categories


def predict_cells(dataset: DataFrame, fitted: Mapping[str, PipelineModel], res: int, population: str = "population") -> DataFrame:
    """``hex_code, population`` and one column per target. No shuffle: a chain of projections."""
    located = dataset.withColumns({"lat": grid.cell_lat("hex_code", res), "long": grid.cell_long("hex_code", res)})
    texts = other_columns(located)
    ready = fill_categories(located, texts) if texts else located
    return models.predict_targets(ready, fitted, ["hex_code", population])


def target_intervals(
    dataset: DataFrame,
    model: PipelineModel,
    target: str,
    calibration: DataFrame,
    res: int,
    alpha: float = 0.05,
) -> DataFrame:
    """``hex_code, lower, prediction, upper`` for every cell.

    ``calibration`` holds ``target`` and ``prediction`` of rows the model was not fitted on; pass
    the training rows' predictions for the narrower in-sample widths.
    """
    conformal.require_fitted(model)
    width = conformal.calibrate(calibration, target, "prediction", alpha)
    preds = predict_cells(dataset.withColumn("population", F.lit(None).cast("double")), {target: model}, res)
    out = conformal.predict_intervals(preds, width, target, target=target)
    return out.select("hex_code", "lower", "prediction", "upper")


def all_intervals(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Interval columns of several targets side by side, by cell."""
    out = None
    for t, df in parts.items():
        named = df.withColumnsRenamed({c: f"{c}_{t}" for c in ("lower", "prediction", "upper")})
        out = named if out is None else out.join(named, "hex_code")
    return out


