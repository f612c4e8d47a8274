"""Imputers as pipeline stages: fitted on training rows, saved and loaded with their pipeline.

``ChainImputer`` learns a chain of regressions, each incomplete column on all others, round after round. The
fitted chain is applied step by step to any row, so a new cell is filled exactly as a training row with the
same gaps. ``NeighbourImputer`` keeps its training rows as donors. Both write ``column + suffix`` for every
column; what they cannot fill gets the training mean, or zero for a column without any value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.operators.prep import add_indicators, fill, fit_fill, knn_values
from terracell.session import cut_lineage, spread

ROWS_A_TASK = 2**17


class FillParams(Params):
    """Columns to fill and how the filled copies are named."""

    columns = Param(Params._dummy(), "columns", "numeric columns", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "ending of the filled copies", TypeConverters.toString)
    indicators = Param(Params._dummy(), "indicators", "columns that get an indicator of gaps", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)

    def of(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def named(self, df: DataFrame, filled: Sequence[Column]) -> DataFrame:
        """``df`` with filled copies and indicators."""
        df = df.withColumns({c + self.of("suffix"): f for c, f in zip(self.of("columns"), filled, strict=True)})
        return add_indicators(df, self.of("indicators"))


def learnt_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    means = fit_fill(df, columns)
    return [float(means[c]) if means[c] is not None else 0.0 for c in columns]


def incomplete(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with gaps, fewest gaps first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return sorted((c for c in columns if counts[c] > 0), key=lambda c: (counts[c], c))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` (stored) in even tasks of at most some ``ROWS_A_TASK`` rows; as it lies where no task has more.

    A forest draws its rows by their place: each task's rows are sorted, so that reruns draw the same ones.
    """
    sizes = df.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if (sizes["most"] or 0) <= ROWS_A_TASK:
        return df
    return cut_lineage(df.repartition(-(-sizes["n"] // ROWS_A_TASK)).sortWithinPartitions(*df.columns))


class ChainImputer(Estimator, FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Round-robin regression of each incomplete column on the others, starting from the means.

    ``kind`` is ``linear`` or ``forest``. Rounds stop early when the mean change of the filled cells is below ``tol``
    deviations. A round is one checkpoint, so the plan does not grow with the rounds. Rows of a large file that lie in a
    few tasks are dealt to more before forests are fitted.
    """

    kind = Param(Params._dummy(), "kind", "linear or forest", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "most rounds", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "mean change in deviations that ends the rounds", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "regularisation of linear steps", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "trees of a forest step", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of forest steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, columns=None, suffix="__x", indicators=(), kind="linear", rounds=10, tol=1e-3, ridge=1e-3, trees=20, seed=42):
        super().__init__()
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})
        for name, value in {"suffix": suffix, "indicators": list(indicators), "kind": kind, "rounds": rounds, "tol": tol, "ridge": ridge, "trees": trees, "seed": seed}.items():
            self._setDefault(**{name: value})

    def step(self, target: str):
        if self.of("kind") == "linear":
            return LinearRegression(featuresCol="_x", labelCol=target, predictionCol="_p", regParam=self.of("ridge"))
        if self.of("kind") == "forest":
            return RandomForestRegressor(
                featuresCol="_x", labelCol=target, predictionCol="_p", numTrees=self.of("trees"), minInstancesPerNode=3, seed=self.of("seed")
            )
        raise ValueError(f"unknown imputer model: {self.of('kind')}")

    def _fit(self, df: DataFrame):
        names = self.of("columns")
        means = learnt_means(df, names)
        gaps = incomplete(df, names)
        state = df.select(*[F.col(c).cast("double").alias(c) for c in names], *[F.col(c).isNull().alias(f"_m_{c}") for c in gaps])
        spread = state.agg(*[F.stddev_pop(c).alias(c) for c in gaps]).first() if gaps else {}
        state = cut_lineage(fill(state, dict(zip(names, means))))
        if gaps and self.of("kind") == "forest":
            state = dealt(state)
        steps: list[tuple[str, object]] = []
        for _ in range(self.of("rounds") if gaps else 0):
            state = state.withColumns({f"_o_{c}": F.col(c) for c in gaps})
            for c in gaps:
                vec = VectorAssembler(inputCols=[o for o in names if o != c], outputCol="_x").transform(state)
                known = vec.filter(~F.col(f"_m_{c}"))
                if not known.head(1):
                    continue  # no value to learn from: the column keeps its start
                fitted = self.step(c).fit(known)
                steps.append((c, fitted))
                state = fitted.transform(vec).withColumn(c, F.when(F.col(f"_m_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
            state = cut_lineage(state)
            change = {c: F.avg(F.when(F.col(f"_m_{c}"), F.abs(F.col(c) - F.col(f"_o_{c}")))) for c in gaps}
            moved = state.agg(*[F.coalesce(v, F.lit(0.0)).alias(c) for c, v in change.items()]).first()
            state = state.drop(*[f"_o_{c}" for c in gaps])
            if all(moved[c] <= self.of("tol") * (spread[c] or 1.0) for c in gaps):
                break
        kind = LinearChain if self.of("kind") == "linear" else ForestChain
        model = kind()._set(columns=names, suffix=self.of("suffix"), indicators=self.of("indicators"), means=means)
        return model.learnt(steps)


class LinearChain(Model, FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Linear steps, applied as one expression over an array of the row's values."""

    steps = Param(Params._dummy(), "steps", "(column number, intercept, coefficients) of each step as JSON", TypeConverters.toString)

    def learnt(self, steps) -> LinearChain:
        names, rows = self.of("columns"), []
        for c, m in steps:
            own = iter(m.coefficients.toArray().tolist())
            rows.append([names.index(c), float(m.intercept), [0.0 if n == c else next(own) for n in names]])
        return self._set(steps=json.dumps(rows))

    def _transform(self, df: DataFrame) -> DataFrame:
        names, rows = self.of("columns"), json.loads(self.of("steps"))
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(names, self.of("means"))])
        if rows:
            gap = F.array(*[F.col(c).isNull() for c in names])
            # a row without gaps takes no step
            chain = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b"), F.array(*map(F.lit, w)).alias("w")) for i, b, w in rows])
            filled = F.aggregate(chain, values, lambda v, s: F.when(F.get(gap, s["i"]), replaced(v, s)).otherwise(v))
            values = F.when(F.array_contains(gap, True), filled).otherwise(values)
        work = "_filled"
        while work in df.columns:
            work += "_"
        return self.named(df.withColumn(work, values), [F.get(work, F.lit(i)) for i in range(len(names))]).drop(work)


def replaced(values: Column, step: Column) -> Column:
    """``values`` with the step's prediction in its place."""
    products = F.zip_with(values, step["w"], lambda x, w: x * w)
    predicted = F.aggregate(products, step["b"], lambda a, x: a + x)
    return F.transform(values, lambda x, i: F.when(i == step["i"], predicted).otherwise(x))


class ForestChain(Model, FillParams, MLWritable, MLReadable):
    """Forest steps, applied one after the other; every forest is saved below the stage."""

    targets = Param(Params._dummy(), "targets", "column of each step", TypeConverters.toListString)

    def learnt(self, steps) -> ForestChain:
        self.forests = [m for _, m in steps]
        return self._set(targets=[c for c, _ in steps])

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.of("columns")
        work = {c: f"_f_{c}" for c in names}
        state = df.withColumns({w: F.coalesce(F.col(c).cast("double"), F.lit(m)) for (c, w), m in zip(work.items(), self.of("means"))})
        for c, forest in zip(self.of("targets"), self.forests, strict=True):
            vec = VectorAssembler(inputCols=[work[o] for o in names if o != c], outputCol="_x").transform(state)
            made = F.when(F.col(c).isNull(), F.col("_p")).otherwise(F.col(work[c]))
            state = forest.transform(vec).withColumn(work[c], made).drop("_x", "_p")
        return self.named(state, [F.col(work[c]) for c in names]).drop(*work.values())

    def copy(self, extra=None) -> ForestChain:
        out = super().copy(extra)
        out.forests = self.forests
        return out

    def write(self) -> MLWriter:
        return PartsWriter(self, {f"forest-{i:03d}": forest.write() for i, forest in enumerate(self.forests)})

    @classmethod
    def read(cls) -> MLReader:
        return PartsReader(cls, lambda stage, path: setattr(
            stage, "forests", [RandomForestRegressionModel.load(f"{path}/forest-{i:03d}") for i in range(len(stage.of("targets")))]
        ))


class PartsWriter(MLWriter):
    """Params of a stage and what else belongs to it, below its path."""

    def __init__(self, stage, parts: dict):
        super().__init__()
        self.stage, self.parts = stage, parts

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        for name, part in self.parts.items():
            part.save(f"{path}/{name}")


class PartsReader(MLReader):
    def __init__(self, kind, complete):
        super().__init__()
        self.kind, self.complete = kind, complete

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        self.complete(stage, path)
        return stage


class NeighbourImputer(Estimator, FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the k nearest training rows that have the value (see ``prep.knn_values``)."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "column that tells rows apart", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, suffix="__x", indicators=(), k=5, key="hex_code"):
        super().__init__()
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})
        self._setDefault(suffix=suffix, indicators=list(indicators), k=k, key=key)

    def _fit(self, df: DataFrame) -> NeighbourFill:
        names = self.of("columns")
        out = NeighbourFill()._set(
            columns=names, suffix=self.of("suffix"), indicators=self.of("indicators"), means=learnt_means(df, names), k=self.of("k"), key=self.of("key")
        )
        out.donors = cut_lineage(df.select(self.of("key"), *[F.col(c).cast("double").alias(c) for c in names]))
        return out


class NeighbourFill(Model, FillParams, MLWritable, MLReadable):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    key = Param(Params._dummy(), "key", "column that tells rows apart", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        names, key = self.of("columns"), self.of("key")
        near = knn_values(df.select(key, *names), self.donors, names, key, self.of("k"))
        near = near.select(key, *[F.col(f"_f_{c}") for c in names])
        filled = [F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}"), F.lit(m)) for c, m in zip(names, self.of("means"))]
        return self.named(df.join(near, key, "left"), filled).drop(*[f"_f_{c}" for c in names])

    def copy(self, extra=None) -> NeighbourFill:
        out = super().copy(extra)
        out.donors = self.donors
        return out

    def write(self) -> MLWriter:
        class Donors:
            save = staticmethod(self.donors.write.parquet)

        return PartsWriter(self, {"donors": Donors})

    @classmethod
    def read(cls) -> MLReader:
        def complete(stage, path: str) -> None:
            stage.donors = stage_session().read.parquet(f"{path}/donors")

        return PartsReader(cls, complete)


def stage_session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def imputer(strategy: str, columns: Sequence[str], indicators: Sequence[str], key: str = "hex_code", **options) -> Estimator:
    """The estimator of a filling strategy that is more than one number a column."""
    if strategy == "knn":
        return NeighbourImputer(columns=list(columns), indicators=list(indicators), key=key, **options)
    kinds = {"linear": "linear", "rf": "forest"}
    if strategy not in kinds:
        raise ValueError(f"unknown imputer: {strategy}")
    return ChainImputer(columns=list(columns), indicators=list(indicators), kind=kinds[strategy], **options)


def filled_in_place(df: DataFrame, stage: Estimator) -> DataFrame:
    """``df`` filled by a stage fitted on itself, under the columns' own names."""
    model = stage.fit(df)
    names, suffix = model.of("columns"), model.of("suffix")
    out = model.transform(spread(df) if isinstance(model, ForestChain) else df)
    return out.withColumns({c: F.col(c + suffix) for c in names}).drop(*[c + suffix for c in names])
