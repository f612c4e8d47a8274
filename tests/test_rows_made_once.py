"""Searches and selection make their rows once, not once for each pass of each fit."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from terracell.operators import models, prep

N = 60


def counted(spark):
    """Rows, and how many of them have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def one(i: int) -> float:
        made.add(1)
        return float(i % 13)

    x = F.udf(one, "double")("id")
    rows = spark.range(N).select(F.col("id").alias("hex_code"), x.alias("x"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 13 * 2.0).alias("y"))
    return rows, made


def test_tuning_makes_rows_once(spark):
    rows, made = counted(spark)
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    found = models.fit_tuned(vec, "y", learners={"linear": (LinearRegression(), {"regParam": [0.0, 0.1]})})
    assert found.params["regParam"] == 0.0 and made.value <= N


def test_stepwise_search_makes_rows_once_a_parameter(spark):
    rows, made = counted(spark)
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    forest = RandomForestRegressor(numTrees=3, seed=1)
    found = models.stepwise_search(vec, "y", forest, {"maxDepth": [1, 3], "minInstancesPerNode": [1, 8]}, k=3)
    assert set(found.params) == {"maxDepth", "minInstancesPerNode"} and len(found.trials) == 4
    assert made.value <= 2 * N


def test_selection_makes_rows_once(spark):
    rows, made = counted(spark)
    noisy = rows.withColumn("z", F.pmod(F.xxhash64("hex_code"), F.lit(11)).cast("double"))
    found = prep.select_features(noisy, ["x", "z"], "y", n_trials=6)
    assert sorted(sum(found.values(), [])) == ["x", "z"]
    assert made.value <= 2 * N  # a checkpoint may make them once more than it stores them
