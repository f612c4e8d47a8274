"""Fitting, search, stacking and prediction with pyspark.ml estimators."""

from __future__ import annotations

import ast
import itertools
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import evaluate as ev
from terracell.operators import folds as fold_ops
from terracell.schema import ALL_TARGETS

# Command-line target names and their columns.
TARGET_COLUMNS = {
    "av-severity": "sumpoor_sev",
    "av-prevalence": "deprived_sev",
    "av-2-prevalence": "dep_2_or_more_sev",
    "av-3-prevalence": "dep_3_or_more_sev",
    "av-4-prevalence": "dep_4_or_more_sev",
    "health": "dep_health_sev",
    "nutrition": "dep_nutrition_sev",
    "housing": "dep_housing_sev",
    "water": "dep_water_sev",
    "sanitation": "dep_sanitation_sev",
    "education": "dep_education_sev",
}


def target_columns(target: str = "all") -> list[str]:
    """The good set for "all", else the one column meant."""
    if target == "all":
        return list(ALL_TARGETS)
    if target not in TARGET_COLUMNS:
        raise ValueError(f"unknown target: {target}")
    return [TARGET_COLUMNS[target]]


@dataclass(frozen=True)
class RunKey:
    """One name for everything saved about a run; built and parsed here only."""

    country: str
    res: int
    threshold: int
    target: str
    cv: str = "normal"
    impute: str = "none"
    scale: str = "none"
    expanded: bool = False
    holdout: str = "normal"
    transform: str = "none"
    interpretable: bool = False
    universal: bool = False

    def text(self) -> str:
        return "~".join(
            [
                self.country.lower(),
                f"res{self.res}",
                f"thres{self.threshold}",
                f"target-{self.target}",
                f"cv-{self.cv}",
                f"impute-{self.impute}",
                f"scale-{self.scale}",
                f"expanded-{str(self.expanded).lower()}",
                f"holdout-{self.holdout}",
                f"transform-{self.transform}",
                f"interpretable-{str(self.interpretable).lower()}",
                f"universal-{str(self.universal).lower()}",
            ]
        )

    def same_data(self) -> str:
        """Prefix of all runs on the same country, resolution, threshold and target."""
        return "~".join(self.text().split("~")[:4]) + "~"

    @staticmethod
    def parse(text: str) -> "RunKey":
        country, res, thres, target, cv, impute, scale, expanded, holdout, transform, plain, universal = text.split("~")
        return RunKey(
            country,
            int(res.removeprefix("res")),
            int(thres.removeprefix("thres")),
            target.removeprefix("target-"),
            cv.removeprefix("cv-"),
            impute.removeprefix("impute-"),
            scale.removeprefix("scale-"),
            expanded == "expanded-true",
            holdout.removeprefix("holdout-"),
            transform.removeprefix("transform-"),
            plain == "interpretable-true",
            universal == "universal-true",
        )


@dataclass
class FitResult:
    target: str
    model: Model
    params: dict
    cv_score: float
    trials: list[dict] = field(default_factory=list)


def default_learners(seed: int = 42) -> dict[str, tuple[Estimator, dict]]:
    """Estimators and their small grids."""
    return {
        "gbt": (GBTRegressor(seed=seed, maxIter=20), {"maxDepth": [3, 5]}),
        "forest": (RandomForestRegressor(seed=seed, numTrees=30), {"maxDepth": [5, 8]}),
        "linear": (LinearRegression(), {"regParam": [0.0, 0.1]}),
    }


def _grid(est: Estimator, options: Mapping[str, Sequence]) -> list:
    builder = ParamGridBuilder()
    for name, values in options.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    return builder.build()


def _value(text: str):
    """A logged parameter as Python value; what is no literal stays text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def _start_maps(name: str, est: Estimator, start: Mapping[str, Sequence[str]]) -> list:
    """Parameter maps of an earlier run of this learner; parameters that it lacks are left out."""
    known = sorted(n for n in start if n != "learner" and est.hasParam(n))
    if name not in start.get("learner", ()) or not known:
        return []
    ps = [est.getParam(n) for n in known]
    return [
        {p: p.typeConverter(_value(v)) for p, v in zip(ps, one, strict=True)}
        for one in itertools.product(*[start[n] for n in known])
    ]


def fit_tuned(
    df: DataFrame,
    target: str,
    features: str = "features",
    fold: str | None = "fold",
    learners: Mapping[str, tuple[Estimator, Mapping[str, Sequence]]] | None = None,
    metric: str = "mse",
    parallelism: int = 2,
    k: int = 3,
    seed: int = 42,
    start: Mapping[str, Sequence[str]] | None = None,
) -> FitResult:
    """Best of several learners and grids by cross validation on the given fold column.

    ``start`` has the parameters of an earlier run (``sinks.earlier_best``): its learner and its values, also those
    outside the grid, are tried first and win ties. The rows are made once for all fits.
    """
    rows = df.filter(F.col(target).isNotNull()).persist()
    try:
        return _best_learner(rows, target, features, fold, learners or default_learners(seed), metric, parallelism, k, seed, start or {})
    finally:
        rows.unpersist()


def _best_learner(rows, target, features, fold, learners, metric, parallelism, k, seed, start) -> FitResult:
    trials, best = [], None
    several = learners.items()
    for name, (est, options) in sorted(several, key=lambda kv: kv[0] not in start.get("learner", ())):
        est = est.copy({est.featuresCol: features, est.labelCol: target})
        maps = _start_maps(name, est, start)
        maps += [m for m in _grid(est, options) if m not in maps]
        cv = CrossValidator(
            estimator=est,
            estimatorParamMaps=maps,
            evaluator=RegressionEvaluator(labelCol=target, metricName=metric),
            numFolds=k,
            seed=seed,
            parallelism=parallelism,
            **({"foldCol": fold} if fold else {}),
        )
        fitted = cv.fit(rows)
        for m, s in zip(maps, fitted.avgMetrics, strict=True):
            trials.append({"learner": name, "score": s, **{p.name: v for p, v in m.items()}})
        at = min(range(len(maps)), key=lambda i: fitted.avgMetrics[i])
        if best is None or fitted.avgMetrics[at] < best.cv_score:
            params = {"learner": name, **{p.name: v for p, v in maps[at].items()}}
            best = FitResult(target, fitted.bestModel, params, fitted.avgMetrics[at])
    best.trials = trials
    return best


def fit_targets(
    df: DataFrame, targets: Sequence[str], features: str = "features", threads: int = 2, **how
) -> dict[str, FitResult]:
    """One tuned model per target over one cached frame."""
    frame = df.persist()
    try:
        with ThreadPoolExecutor(threads) as pool:
            found = list(pool.map(lambda t: fit_tuned(frame, t, features, **how), targets))
    finally:
        frame.unpersist()
    return {r.target: r for r in found}


def random_search(
    df: DataFrame,
    target: str,
    estimator: Estimator,
    space: Mapping[str, Sequence],
    n_trials: int = 20,
    k: int = 5,
    features: str = "features",
    fold: str | None = "fold",
    seed: int = 42,
) -> FitResult:
    """Random parameter draws, mean MAE over the folds, best kept. The rows are made once for all fits."""
    rng = random.Random(seed)
    every = list(itertools.product(*space.values()))
    drawn = rng.sample(every, min(n_trials, len(every)))
    est = estimator.copy({estimator.featuresCol: features, estimator.labelCol: target})
    maps = [{est.getParam(n): v for n, v in zip(space, d, strict=True)} for d in drawn]
    cv = CrossValidator(
        estimator=est,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, metricName="mae"),
        numFolds=k,
        seed=seed,
        parallelism=2,
        **({"foldCol": fold} if fold else {}),
    )
    rows = df.filter(F.col(target).isNotNull()).persist()
    try:
        fitted = cv.fit(rows)
    finally:
        rows.unpersist()
    scores = list(fitted.avgMetrics)
    at = scores.index(min(scores))
    named = [{p.name: v for p, v in m.items()} for m in maps]
    return FitResult(
        target, fitted.bestModel, named[at], scores[at], [{"score": s, **n} for s, n in zip(scores, named, strict=True)]
    )


def early_stopped_rounds(
    df: DataFrame,
    target: str,
    estimator: Estimator,
    patience: int = 5,
    max_rounds: int = 100,
    k: int = 5,
    features: str = "features",
    fold: str = "fold",
) -> tuple[list[float], int]:
    """Mean absolute error of each number of boosting rounds over held-out folds, and the best number.

    Rounds end when the best is ``patience`` rounds old. Fits grow by doubling: the first trees of a longer fit are
    those of a shorter one, so the outcome is that of a rule asked after each round, for at most four times its trees.
    """
    if patience < 1 or max_rounds < 1:
        raise ValueError("patience and max_rounds start at 1")
    est = estimator.copy({estimator.featuresCol: features, estimator.labelCol: target})
    rows = df.filter(F.col(target).isNotNull()).persist()
    try:
        grown = min(2 * patience, max_rounds)
        while True:
            each = []
            for f in range(k):
                model = est.fit(rows.filter(F.col(fold) != f), {est.maxIter: grown})
                each.append(model.evaluateEachIteration(rows.filter(F.col(fold) == f), "absolute"))
            losses = [sum(at) / k for at in zip(*each, strict=True)]
            best = 0
            for i, loss in enumerate(losses):
                if loss < losses[best]:
                    best = i
                if i - best >= patience:
                    return losses[: i + 1], best + 1
            if grown == max_rounds:
                return losses, best + 1
            grown = min(2 * grown, max_rounds)
    finally:
        rows.unpersist()


def early_stopped_search(
    df: DataFrame,
    target: str,
    estimator: Estimator,
    space: Mapping[str, Sequence],
    patience: int = 5,
    max_rounds: int = 100,
    k: int = 5,
    features: str = "features",
    fold: str = "fold",
) -> FitResult:
    """Each parameter choice of a boosted learner with its own number of rounds; the best is fitted on all rows.

    A trial has its parameters, the best round as ``maxIter``, the rounds looked at and the score.
    """
    if "maxIter" in space:
        raise ValueError("the number of rounds is found by the stopping rule")
    trials = []
    for values in itertools.product(*space.values()):
        named = dict(zip(space, values, strict=True))
        est = estimator.copy({estimator.getParam(n): v for n, v in named.items()})
        losses, best = early_stopped_rounds(df, target, est, patience, max_rounds, k, features, fold)
        trials.append({**named, "maxIter": best, "rounds": len(losses), "score": losses[best - 1]})
    first = min(trials, key=lambda t: t["score"])
    params = {n: first[n] for n in (*space, "maxIter")}
    est = estimator.copy({estimator.featuresCol: features, estimator.labelCol: target})
    model = est.fit(df.filter(F.col(target).isNotNull()), {est.getParam(n): v for n, v in params.items()})
    return FitResult(target, model, params, first["score"], trials)


def stepwise_search(
    df: DataFrame,
    target: str,
    estimator: Estimator,
    space: Mapping[str, Sequence],
    features: str = "features",
    fold: str | None = "fold",
    k: int = 5,
    seed: int = 42,
    patience: int | None = None,
    max_rounds: int = 100,
) -> FitResult:
    """One parameter at a time, each keeping the best value so far.

    With ``patience``, each trial of a boosted learner stops early and its best number of rounds is kept too.
    """
    chosen: dict = {}
    result, trials = None, []
    for name, values in space.items():
        base = estimator.copy({estimator.getParam(n): v for n, v in chosen.items()})
        if patience is None:
            step = random_search(df, target, base, {name: values}, len(values), k, features, fold, seed)
        else:
            step = early_stopped_search(df, target, base, {name: values}, patience, max_rounds, k, features, fold)
        trials += [{**chosen, **t} for t in step.trials]
        if result is None or step.cv_score <= result.cv_score:
            chosen |= step.params
            result = step
    return FitResult(target, result.model, chosen, result.cv_score, trials)


def parameter_sweep(spark: SparkSession, options: Mapping[str, Sequence]) -> DataFrame:
    """Run table of a full parameter product, unfolded one option at a time."""
    runs = spark.range(1).select()
    for name, values in options.items():
        runs = runs.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return runs


def best_trial(trials: DataFrame, by: Sequence[str], score: str, config: str) -> DataFrame:
    return trials.groupBy(*by).agg(F.min_by(config, score).alias(config), F.min(score).alias(score))


def fit_baseline(
    train: DataFrame, test: DataFrame, target: str, n_features: int, estimator: Estimator | None = None, features: str = "features"
) -> tuple[Model, DataFrame]:
    """One model and its test scores, adjusted R2 included."""
    est = estimator or GBTRegressor(seed=42)
    est = est.copy({est.featuresCol: features, est.labelCol: target})
    model = est.fit(train.filter(F.col(target).isNotNull()))
    return model, ev.score(model.transform(test), target, "prediction", n_features=n_features)


@dataclass
class StackedModel:
    parts: dict[str, Model]
    meta: Model

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        for name, m in self.parts.items():
            out = m.transform(out).withColumnRenamed("prediction", f"_s_{name}")
        out = _assemble(out, [f"_s_{n}" for n in self.parts], "_stack")
        return self.meta.transform(out).drop("_stack", *[f"_s_{n}" for n in self.parts])


def _assemble(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def fit_stacked(
    df: DataFrame, target: str, learners: Mapping[str, Estimator], k: int = 3, features: str = "features", keys: Sequence[str] = ("hex_code",), seed: int = 42
) -> StackedModel:
    """Linear model over out-of-fold predictions of the parts; the parts are then refitted."""
    rows = fold_ops.random_folds(df.filter(F.col(target).isNotNull()), keys, k, seed).persist()
    parts = {n: e.copy({e.featuresCol: features, e.labelCol: target}) for n, e in learners.items()}
    held_out = None
    for f in range(k):
        train, held = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        for n, e in parts.items():
            held = e.fit(train).transform(held).withColumnRenamed("prediction", f"_s_{n}")
        held_out = held if held_out is None else held_out.unionByName(held)
    stack = _assemble(held_out, [f"_s_{n}" for n in parts], "_stack")
    meta = LinearRegression(featuresCol="_stack", labelCol=target).fit(stack)
    full = {n: e.fit(rows) for n, e in parts.items()}
    rows.unpersist()
    return StackedModel(full, meta)


def predict_targets(df: DataFrame, models: Mapping[str, Model], keep: Sequence[str], features: str = "features") -> DataFrame:
    """One prediction column per target; map-only."""
    out = df
    for target, model in models.items():
        plain = out.columns
        out = model.transform(out).select(*plain, F.col("prediction").alias(f"pred_{target}"))
    return out.select(*keep, *[F.col(f"pred_{t}").alias(t) for t in models])


def importance_rows(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    gains = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(g)) for n, g in zip(names, gains, strict=True)], "feature string, importance double")


def save_model(model: Model, root: str, key: RunKey) -> str:
    path = f"{root}/{key.text()}"
    fitted = model if isinstance(model, PipelineModel) else PipelineModel([model])
    fitted.write().overwrite().save(path)
    return path


def load_models(spark: SparkSession, registry: DataFrame, root: str, pattern: str = "%") -> dict[str, PipelineModel]:
    """Models whose run key matches, by target. The registry holds a row per saved run.

    Two matching runs of one target are an error: the pattern has to name one.
    """
    keys = [r["run_id"] for r in registry.filter(F.col("run_id").like(pattern)).select("run_id").distinct().collect()]
    by_target: dict[str, str] = {}
    for k in sorted(keys):
        target = RunKey.parse(k).target
        if target in by_target:
            raise ValueError(f"several runs of {target} match: {by_target[target]}, {k}")
        by_target[target] = k
    return {target: PipelineModel.load(f"{root}/{k}") for target, k in by_target.items()}


def pipeline_of(stages: Sequence, estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[*stages, estimator])
