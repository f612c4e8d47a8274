"""Imputers as stages: saved with their pipeline, blind to test rows."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import imputers, models, prep
from terracell.plans import training

NAMES = ["a", "b", "c"]


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.gauss(0, 1)
        b, c = 2 * a + 1, rnd.gauss(0, 1) - a
        out.append((seed * 1000 + i, *[None if rnd.random() < 0.2 else x for x in (a, b, c)]))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "hex_code long, a double, b double, c double")


@pytest.mark.parametrize("strategy", ["knn", "linear", "rf"])
def test_a_saved_stage_fills_new_rows_as_the_fitted_one(spark, tmp_path, strategy):
    model = prep.pipeline([imputers.imputer(strategy, NAMES, ["b"])]).fit(frame(spark, rows(150, 1)))
    model.write().save(f"{tmp_path}/m")
    new = rows(60, 2) + [(9, None, None, None)]
    got = [m.transform(frame(spark, new)).collect() for m in (model, PipelineModel.load(f"{tmp_path}/m"))]
    assert sorted(got[0]) == sorted(got[1])
    filled = {r["hex_code"]: r for r in got[0]}
    for i, *values in new:
        for n, v in zip(NAMES, values):
            assert filled[i][f"{n}__x"] is not None
            assert v is None or filled[i][f"{n}__x"] == v
        assert filled[i]["b_missing"] == (values[1] is None)
    if strategy != "knn":  # b follows from a
        off = [abs(filled[i]["b__x"] - 2 * a - 1) for i, a, b, _ in new if a is not None and b is None]
        assert off and sum(off) / len(off) < {"linear": 0.1, "rf": 0.8}[strategy]


def test_a_chain_fills_training_rows_as_it_did_in_the_fit(spark):
    """Applied step by step, the chain ends where the rounds of the fit have ended."""
    df = frame(spark, [(i, a, None if i % 4 == 0 else 2 * a, None if i % 5 == 0 else 3 * a + i % 2) for i, a in enumerate([x / 10 for x in range(80)])])
    model = imputers.imputer("linear", NAMES, [], rounds=8, ridge=0.0).fit(df)
    got = {r["hex_code"]: r for r in model.transform(df).collect()}
    assert all(abs(got[i]["b__x"] - 2 * i / 10) < 0.05 for i in range(80))
    plain = imputers.imputer("linear", ["a"], []).fit(df.select("hex_code", "a"))
    assert plain.transform(df.select("hex_code", "a")).filter("a__x <> a").count() == 0


def test_columns_without_values_and_empty_donors(spark):
    data = [(i, float(i), None, float(i % 3)) for i in range(10)]
    for strategy in ("knn", "linear", "rf"):
        model = imputers.imputer(strategy, NAMES, []).fit(frame(spark, data))
        got = model.transform(frame(spark, [(99, None, None, 1.0)])).first()
        assert got["b__x"] == 0.0 and got["a__x"] is not None


@pytest.fixture(scope="module")
def cells(spark):
    at = spark.range(200).withColumns({"lat": 4.0 + (F.col("id") % 20) * 0.4, "long": 3.0 + F.floor(F.col("id") / 20) * 0.4})
    x = (F.col("id") % 40) / 40.0
    return at.select(
        grid.cell_of("lat", "long", 5).alias("hex_code"), F.when(F.col("id") % 7 != 0, x).alias("x"), (2 * x).alias("twice"),
        F.lit(50).alias("survey"), F.exp(-2 * x).alias("dep_housing_sev"),
    ).dropDuplicates(["hex_code"])


@pytest.mark.parametrize("impute", ["knn", "linear", "rf", "none"])
def test_training_saves_the_fill(spark, cells, tmp_path, impute):
    config = training.TrainConfig(
        "Testland", 5, 30, "housing", k=3, impute=impute, learners={"forest": (RandomForestRegressor(numTrees=5, seed=1), {"maxDepth": [4]})}
    )
    training.save_run(training.train(cells, config), config, str(tmp_path))
    loaded = models.load_models(spark, spark.read.parquet(f"{tmp_path}/runs"), f"{tmp_path}/models")["dep_housing_sev"]
    new = cells.withColumns({"lat": grid.cell_lat("hex_code", 5), "long": grid.cell_long("hex_code", 5)})
    got = loaded.transform(new).select("x", "x__x", "twice", "prediction").collect()
    assert all(r["prediction"] is not None for r in got)
    for r in got:
        if r["x"] is None:
            assert impute != "none" and abs(r["x__x"] - r["twice"] / 2) < 0.5
    assert (len(got) < cells.count()) == (impute == "none")


def test_test_rows_do_not_move_the_fit(spark, cells):
    """The stage learns from the training rows that ``prepare`` gets and nothing else."""
    config = training.TrainConfig("Testland", 5, 30, "housing", k=3, impute="linear")
    names = ["x", "twice"]
    halves = cells.withColumn("is_test", F.col("hex_code") % 2 == 0)
    moved = halves.withColumn("twice", F.when(F.col("is_test"), 1000.0).otherwise(F.col("twice")))
    steps = [training.prepare(h.filter("not is_test"), names, config).stages[0].of("steps") for h in (halves, moved)]
    assert steps[0] == steps[1]
