"""Training job: dataset to one saved pipeline per target, with scores and run rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import columns as cols
from terracell.operators import evaluate as ev
from terracell.operators import folds, imputers, joins, models, prep
from terracell.operators.aggregates import keep_one
from terracell.operators.spatial import points_in_areas
from terracell.sources import sinks

# Features that exist for one country only.
COUNTRY_ONLY = {
    "nigeria": [
        "n_education",
        "n_health",
        "OSM_hospital",
        "OSM_school",
        "health_gv_osm",
        "school_gv_osm",
        "estimate_dau",
    ]
}


@dataclass(frozen=True)
class TrainConfig:
    country: str
    res: int = 7
    threshold: int = 30
    target: str = "all"
    holdout: str = "normal"
    cv: str = "normal"
    test_size: float = 0.2
    k: int = 5
    cuts: int = 5
    impute: str = "median"
    scale: str = "standard"
    transform: str = "none"
    interpretable: bool = False
    universal_only: bool = False
    expanded: bool = False
    seed: int = 42
    learners: Mapping | None = field(default=None, hash=False)
    not_features: tuple[str, ...] = ("country", "res", "threshold")

    def key(self, target: str) -> models.RunKey:
        return models.RunKey(
            self.country,
            self.res,
            self.threshold,
            target,
            self.cv,
            self.impute,
            self.scale,
            self.expanded,
            self.holdout,
            self.transform,
            self.interpretable,
            self.universal_only,
        )


@dataclass
class Trained:
    target: str
    model: PipelineModel
    result: models.FitResult
    scores: DataFrame
    test: DataFrame


def distinct_cells(datasets: DataFrame) -> DataFrame:
    """One row per cell; of several the one with most survey rows, then the first country, then by content."""
    order = [F.coalesce(-F.col("survey"), F.lit(0))]
    if "country" in datasets.columns:
        order.append(F.col("country"))
    order.append(F.xxhash64(*[c for c, t in datasets.dtypes if not t.startswith("map")]))
    return keep_one(datasets, ["hex_code"], order)


def with_expanded_targets(dataset: DataFrame, expanded: DataFrame) -> DataFrame:
    named = cols.rename_long(cols.drop_matching(distinct_cells_of(expanded), r"_count$"))
    targets = [c for c in named.columns if "_sev" in c and c in dataset.columns]
    return joins.replace_targets(dataset, named, targets)


def distinct_cells_of(expanded: DataFrame) -> DataFrame:
    return keep_one(expanded, ["hex_code"], [-F.col("sumpoor_count")])


def clip_to_country(dataset: DataFrame, shape: DataFrame, key: str, res: int) -> DataFrame:
    """Cells whose centroid lies in the country."""
    at = dataset.withColumns({"_lat": grid.cell_lat("hex_code", res), "_long": grid.cell_long("hex_code", res)})
    return points_in_areas(at, shape, key, x="_long", y="_lat", how="left_semi").select(*dataset.columns)


def feature_names(dataset: DataFrame, config: TrainConfig) -> list[str]:
    names = [c for c in cols.features_before(dataset, "survey") if c != "hex_code" and c not in config.not_features]
    if config.universal_only:
        names = [c for c in names if c not in COUNTRY_ONLY.get(config.country.lower(), [])]
    if config.interpretable:
        names = [c for c in names if "auto_" not in c]
    return names


def split(df: DataFrame, config: TrainConfig, targets: Sequence[str]) -> DataFrame:
    """``is_test`` by the chosen holdout and ``fold`` over the training rows."""
    if config.holdout == "normal":
        held = folds.random_holdout(df, ["hex_code"], config.test_size, config.seed)
    elif config.holdout == "stratified":
        one = targets[0]
        held = folds.interval_holdouts(df, ["hex_code"], [one], config.test_size, config.cuts, config.seed)
        held = held.withColumnRenamed(f"is_test_{one}", "is_test")
    elif config.holdout == "spatial":
        held = folds.spatial_holdout(df, config.test_size, config.seed)
    else:
        raise ValueError(f"unknown holdout: {config.holdout}")
    train = held.filter(~F.col("is_test"))
    slim = train.select("hex_code", "lat", "long", *targets)
    numbered = folds.cv_folds(slim, config.cv, config.k, targets[0], config.seed, config.cuts)
    return held.join(numbered.select("hex_code", "fold"), "hex_code", "left")


def prepare(train: DataFrame, names: Sequence[str], config: TrainConfig) -> PipelineModel:
    """Fill, scale, encode and assemble, all learnt from the training rows and saved with the pipeline."""
    numeric = [c for c in cols.numeric_columns(train, with_bool=True) if c in names]
    texts = [c for c in names if c not in numeric]
    lacking = prep.missing_columns(train, numeric)
    if config.impute in ("mean", "median", "none"):
        values = dict.fromkeys(numeric) if config.impute == "none" else prep.fit_fill(train, numeric, config.impute)
        if config.impute != "none":
            values = {c: v if v is not None else 0.0 for c, v in values.items()}
        fill = prep.fill_stage(values, lacking)
    else:
        fill = imputers.imputer(config.impute, numeric, lacking).fit(train)
    stages = [fill]
    suffix = "__x"
    if config.scale != "none":
        filled = fill.transform(train).select(*[F.col(f"{c}__x").alias(c) for c in numeric])
        stages.append(prep.scale_stage(prep.fit_scale(filled, numeric, config.scale)))
        suffix = "__z"
    low, high = prep.card_split(train, texts) if texts else ([], [])
    stages += prep.one_hot_stages(low)
    if high:
        stages.append(prep.ordinal_stage(high))
    inputs = [c + suffix for c in numeric] + [f"{c}_missing" for c in lacking]
    inputs += [f"{c}_hot" for c in low] + [f"{c}_code" for c in high]
    # the learners take no gaps: without a fill, rows that have one neither train nor get a prediction
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip" if config.impute == "none" else "error"))
    return prep.pipeline(stages).fit(train)


def train(dataset: DataFrame, config: TrainConfig, runs: DataFrame | None = None) -> dict[str, Trained]:
    """Models and test scores per target; scores are on the untransformed scale.

    With the run table of earlier trainings, a target's search starts from the best of them for the same country,
    resolution, threshold and target.
    """
    targets = models.target_columns(config.target)
    known = cols.require(dataset, ["hex_code", "survey", *targets]).na.drop("all", subset=targets)
    located = known.withColumns(
        {"lat": grid.cell_lat("hex_code", config.res), "long": grid.cell_long("hex_code", config.res)}
    )
    names = [*[n for n in feature_names(dataset, config) if n not in ("lat", "long")], "lat", "long"]
    texts = [c for c, t in located.dtypes if c in names and t == "string"]
    located = prep.fill_categories(located, texts) if texts else located
    # a stratified holdout follows the classes of its target, so each target has its own
    parts = [[t] for t in targets] if config.holdout == "stratified" else [targets]
    out = {}
    for part in parts:
        out |= train_part(located.select("hex_code", *names, *part), names, part, config, runs)
    return out


def train_part(
    rows: DataFrame, names: Sequence[str], targets: Sequence[str], config: TrainConfig, runs: DataFrame | None = None
) -> dict[str, Trained]:
    """Models of the targets that share one split."""
    frame = split(rows, config, targets).persist()
    out = {}
    try:
        ready = prepare(frame.filter(~F.col("is_test")), names, config)
        coded = ready.transform(frame).select("hex_code", "is_test", "fold", "features", *targets).persist()
        for t in targets:
            rows, back = coded, []
            if config.transform == "log":
                rows, back = prep.log_target(coded, t, "_y"), [prep.inverse_stage("exp(prediction)")]
            elif config.transform == "power":
                power = prep.fit_power(coded.filter(~F.col("is_test")), t)
                rows, back = coded.withColumn("_y", power.apply(F.col(t))), [prep.inverse_stage(power.invert_sql("prediction"))]
            elif config.transform != "none":
                raise ValueError(f"unknown target transform: {config.transform}")
            label = t if config.transform == "none" else "_y"
            start = None if runs is None else sinks.earlier_best(runs, config.key(t).same_data())
            result = models.fit_tuned(
                rows.filter(~F.col("is_test")), label, learners=config.learners, k=config.k, seed=config.seed, start=start
            )
            test = PipelineModel([result.model, *back]).transform(rows.filter("is_test"))
            scores = ev.score(test, t, "prediction")
            # the inverse is a stage, so a loaded pipeline predicts on the scale of the target
            pipeline = PipelineModel([*ready.stages, result.model, *back])
            out[t] = Trained(t, pipeline, result, scores, test.select("hex_code", t, "prediction"))
        coded.unpersist()
    finally:
        frame.unpersist()
    return out


def save_run(trained: Mapping[str, Trained], config: TrainConfig, root: str) -> None:
    """Pipelines under their run key, and params, tags and scores as rows of the run table."""
    for t, done in trained.items():
        key = config.key(t)
        path = models.save_model(done.model, f"{root}/models", key)
        spark = done.scores.sparkSession
        sinks.log_run(
            sinks.run_rows(
                spark,
                key.text(),
                params=done.result.params,
                metrics={"cv_mse": done.result.cv_score},
                tags={"country": config.country, "cv": config.cv, "impute": config.impute, "scale": config.scale},
                artifacts=(path,),
            ),
            f"{root}/runs",
        )
        sinks.log_run(sinks.score_rows(done.scores, key.text(), t), f"{root}/runs")
