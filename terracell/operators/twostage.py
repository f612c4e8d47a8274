"""Two-stage regression for targets with inflated values.

A classifier says whether the target is one of the inflated values or lies between them, and a
regressor trained on the other rows gives the number in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.util import as_col


@dataclass(frozen=True)
class ClassPlan:
    """Ordinal classes of an inflated target: intervals and points, in value order.

    ``starts_at_point`` and ``ends_at_point`` tell whether the smallest and largest inflated value
    sit on the edge of the range, which removes the interval beyond them.
    """

    values: tuple[float, ...]
    starts_at_point: bool
    ends_at_point: bool

    @property
    def n_classes(self) -> int:
        return 2 * len(self.values) + 1 - int(self.starts_at_point) - int(self.ends_at_point)

    @property
    def first(self) -> int:
        return 0 if self.starts_at_point else 1

    @property
    def point_classes(self) -> list[int]:
        return [self.first + 2 * i for i in range(len(self.values))]

    def label(self, y: Column | str) -> Column:
        """Class number: twice the inflated values passed, one more when standing on one."""
        y = as_col(y)
        passed = sum((F.when(y > F.lit(v), 2).otherwise(0) for v in self.values), F.lit(0))
        on_point = sum((F.when(y == F.lit(v), 1).otherwise(0) for v in self.values), F.lit(0))
        raw = passed + on_point - (1 if self.starts_at_point else 0)
        bounded = F.greatest(F.lit(0), F.least(raw, F.lit(self.n_classes - 1)))
        return F.when(y.isNotNull(), bounded.cast("double"))


def plan_classes(df: DataFrame, target: str, inflated: Sequence[float] = (0.0,)) -> ClassPlan:
    values = tuple(sorted(float(v) for v in inflated))
    if len(set(values)) != len(values):
        raise ValueError("inflated values must be unique")
    row = df.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    return ClassPlan(values, values[0] == row["lo"], values[-1] == row["hi"])


@dataclass
class TwoStageModel:
    plan: ClassPlan
    classifier: Model
    regressor: Model

    def predict(self, df: DataFrame, weighted: bool = False, count_twice: bool = False, name: str = "prediction") -> DataFrame:
        """Strict: the inflated value of a point class, else the regressor's number.

        Weighted: inflated values and the regressor's number averaged by class probability. A
        number that itself lands on an inflated value is weighted once unless ``count_twice``.
        """
        staged = self.regressor.transform(
            self.classifier.transform(df.drop("prediction")).withColumnRenamed("prediction", "_cls")
            .drop("rawPrediction")
        ).withColumnRenamed("prediction", "_reg")
        points = self.plan.point_classes
        if not weighted:
            value = F.col("_reg")
            for c, v in zip(points, self.plan.values, strict=True):
                value = F.when(F.col("_cls") == c, F.lit(v)).otherwise(value)
        else:
            staged = staged.withColumn("_pr", vector_to_array("probability"))
            prob = [F.coalesce(F.get("_pr", F.lit(c)), F.lit(0.0)) for c in points]
            own = self.plan.label("_reg")
            is_point = own.isin([float(c) for c in points])
            own_prob = F.coalesce(F.get("_pr", own.cast("int")), F.lit(0.0))
            if not count_twice:
                own_prob = F.when(is_point, F.lit(0.0)).otherwise(own_prob)
            top = sum((p * F.lit(v) for p, v in zip(prob, self.plan.values, strict=True)), F.lit(0.0))
            norm = sum(prob, F.lit(0.0)) + own_prob
            value = F.coalesce(F.try_divide(top + own_prob * F.col("_reg"), norm), F.col("_reg"))
        return staged.withColumn(name, value).drop(
            *[c for c in ("_cls", "_reg", "_pr", "probability") if c != name]
        )


def fit_two_stage(
    df: DataFrame,
    target: str,
    classifier: Estimator,
    regressor: Estimator,
    inflated: Sequence[float] = (0.0,),
    features: str = "features",
) -> TwoStageModel:
    plan = plan_classes(df, target, inflated)
    rows = df.filter(F.col(target).isNotNull()).withColumn("_label", plan.label(target))
    cls = classifier.copy({classifier.labelCol: "_label", classifier.featuresCol: features}).fit(rows)
    between = rows.filter(~F.col("_label").isin([float(c) for c in plan.point_classes]))
    if between.isEmpty():
        raise ValueError("every training row is an inflated value; nothing is left to regress on")
    reg = regressor.copy({regressor.labelCol: target, regressor.featuresCol: features}).fit(between)
    return TwoStageModel(plan, cls, reg)
