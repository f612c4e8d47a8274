"""Model fitting, two-stage, stacking, search and encoding-quality queries (rows-only checks)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.q_jobs import work_dir
from catalog.q_prep import survey_features
from terracell.operators import evaluate as ev
from terracell.operators import folds, models, quality, twostage
from terracell.session import cut_lineage
from terracell.sources import sinks

X = ["lat", "long", "age"]


def ready(spark, d):
    """Cells with features, stored, so that the survey is read once however many fits follow, and folds."""
    f = cut_lineage(survey_features(spark, d).na.drop(subset=X))
    v = VectorAssembler(inputCols=X, outputCol="features").transform(f)
    return folds.random_folds(v, ["hex_code"], 3)


@query("M1 M2 M4 T6", None)
def tuned_models(spark, d):
    small = {"linear": (LinearRegression(), {"regParam": [0.0, 0.1]}), "forest": (RandomForestRegressor(seed=1, numTrees=10), {"maxDepth": [4]})}
    found = models.fit_targets(ready(spark, d), ["housing", "water"], learners=small)
    rows = [(t, r.params["learner"], float(r.cv_score)) for t, r in found.items()]
    return spark.createDataFrame(rows, "target string, learner string, mse double")


@query("M5 V4 M17", None)
def baseline_model(spark, d):
    r = ready(spark, d)
    est = GBTRegressor(maxIter=5, seed=1)
    model, scores = models.fit_baseline(r.filter("fold <> 0"), r.filter("fold = 0"), "housing", len(X), est)
    return rounded(scores)


@query("M17", None)
def feature_importance(spark, d):
    m = RandomForestRegressor(numTrees=10, seed=1, labelCol="housing").fit(ready(spark, d))
    return rounded(models.importance_rows(spark, m, X))


@query("M6 T6", None)
def random_search(spark, d):
    est = RandomForestRegressor(numTrees=5, seed=1)
    r = models.random_search(ready(spark, d), "housing", est, {"maxDepth": [2, 4, 6], "minInstancesPerNode": [1, 5]}, 3, 3)
    return spark.createDataFrame([(float(t["score"]), int(t["maxDepth"])) for t in r.trials], "mae double, max_depth int")


@query("M7", None)
def stepwise_search(spark, d):
    est = RandomForestRegressor(numTrees=5, seed=1)
    r = models.stepwise_search(ready(spark, d), "housing", est, {"maxDepth": [2, 5], "minInstancesPerNode": [1, 10]}, k=3)
    return spark.createDataFrame([(k, int(v)) for k, v in r.params.items()], "name string, value int")


@query("M7", None)
def early_stopped_boosting(spark, d):
    """Error of each number of boosting rounds until the best is old enough, and whether it is the best."""
    losses, best = models.early_stopped_rounds(ready(spark, d), "housing", GBTRegressor(seed=1), k=3)
    rows = [(i, float(loss), i == best) for i, loss in enumerate(losses, 1)]
    return spark.createDataFrame(rows, "round int, mae double, best boolean")


@query("M4 K10", None)
def warm_start(spark, d):
    """Trials of a second search that starts from the stored run of the first, in their order."""
    rows, root = ready(spark, d), work_dir(spark)
    grid = {"linear": (LinearRegression(), {"regParam": [0.0, 0.1, 0.003]})}
    first = models.fit_tuned(rows, "housing", learners=grid)
    sinks.log_run(sinks.run_rows(spark, "cells~1", params=first.params), root)
    sinks.log_run(sinks.score_rows(ev.score(first.model.transform(rows), "housing", "prediction"), "cells~1", "housing"), root)
    start = sinks.earlier_best(spark.read.parquet(root), "cells~")
    other = {
        "forest": (RandomForestRegressor(seed=1), {"maxDepth": [4]}),
        "linear": (LinearRegression(), {"regParam": [0.03, 0.3]}),
    }
    again = models.fit_tuned(rows, "housing", learners=other, start=start)
    out = [(i, t["learner"], float(t.get("regParam", "nan")), float(t["score"])) for i, t in enumerate(again.trials)]
    return spark.createDataFrame(out, "trial int, learner string, reg_param double, mse double")


@query("M9 M10 M11 Y4", None)
def two_stage_model(spark, d):
    r = ready(spark, d)
    m = twostage.fit_two_stage(
        r, "water", RandomForestClassifier(numTrees=10, seed=1), RandomForestRegressor(numTrees=10, seed=1), [0.0, 1.0]
    )
    strict = m.predict(r, name="strict").select("hex_code", "strict")
    weighted = m.predict(r, weighted=True, name="weighted").select("hex_code", "weighted")
    return rounded(strict.join(weighted, "hex_code"))


@query("M12 X21 V8", None)
def class_model(spark, d):
    r = ready(spark, d).filter("housing IS NOT NULL").withColumn("label", folds.fixed_class("housing", [i / 5 for i in range(6)]).cast("double"))
    m = RandomForestClassifier(numTrees=10, seed=1).fit(r.filter("fold <> 0"))
    return rounded(ev.class_report(m.transform(r.filter("fold = 0")), "label", "prediction"))


@query("M13", None)
def stacked_model(spark, d):
    parts = {"linear": LinearRegression(), "forest": RandomForestRegressor(numTrees=5, seed=1)}
    r = ready(spark, d).drop("fold")
    return rounded(models.fit_stacked(r, "housing", parts).predict(r).select("hex_code", "prediction"))


@query("M14 M15 M16 K4", None)
def predicted_targets(spark, d):
    r = ready(spark, d)
    fitted = {t: LinearRegression(labelCol=t).fit(r.filter(F.col(t).isNotNull())) for t in ("housing", "water")}
    return rounded(models.predict_targets(r, fitted, ["hex_code", "n"]))


@query("V10 W6", None)
def encoding_quality(spark, d):
    from catalog.fixtures import v_patch
    from terracell.operators.encode import encode_patches

    p = v_patch(spark, d)
    codes = encode_patches(p, 8).select("hex_code", F.array(*[F.col(f"f_{i}") for i in range(8)]).alias("code"))
    both = p.join(codes, "hex_code").select("hex_code", F.col("pixels").alias("a"), F.col("code").alias("b"))
    return rounded(quality.encoding_quality(both, "a", "b", m=20, k=10))
