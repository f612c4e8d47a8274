"""Early stopping, warm starts and GeoJSON outlines."""

import json

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from terracell.functions import geom
from terracell.operators import models
from terracell.plans import training
from terracell.sources import readers, sinks


@pytest.fixture(scope="module")
def rows(spark):
    """A step with noise, which boosting soon learns by heart."""
    data = [(Vectors.dense([i / 200.0]), float(i > 90) + ((i * 7919) % 101) / 150.0, i % 3) for i in range(200)]
    named = spark.createDataFrame(data, ["features", "y", "fold"])
    return named.withColumn("fold", F.col("fold").cast("int")).coalesce(1).persist()


def test_early_stop_is_that_of_a_replay_of_all_rounds(rows):
    est, k, most, patience = GBTRegressor(seed=3, maxDepth=3, stepSize=0.4), 3, 20, 2
    each = []
    for f in range(k):
        m = est.fit(rows.filter(F.col("fold") != f), {est.labelCol: "y", est.maxIter: most})
        each.append(m.evaluateEachIteration(rows.filter(F.col("fold") == f), "absolute"))
    replay = [sum(at) / k for at in zip(*each)]
    stop = next(i for i in range(most) if i - min(range(i + 1), key=replay.__getitem__) >= patience)
    losses, best = models.early_stopped_rounds(rows, "y", est, patience, most, k)
    assert len(losses) == stop + 1 < most
    assert losses == pytest.approx(replay[: stop + 1])
    assert best - 1 == min(range(stop + 1), key=replay.__getitem__)


def test_early_stop_ends_at_the_most_rounds(rows):
    losses, best = models.early_stopped_rounds(rows, "y", GBTRegressor(seed=3), 3, 2, 3)
    assert len(losses) == 2 and 1 <= best <= 2
    with pytest.raises(ValueError, match="start at 1"):
        models.early_stopped_rounds(rows, "y", GBTRegressor(), 0)


def test_stepwise_search_keeps_the_best_number_of_rounds(rows):
    est = GBTRegressor(seed=3, stepSize=0.4)
    found = models.stepwise_search(rows, "y", est, {"maxDepth": [1, 3], "minInstancesPerNode": [1, 8]}, k=3, patience=2, max_rounds=20)
    assert set(found.params) == {"maxDepth", "minInstancesPerNode", "maxIter"}
    assert found.model.getNumTrees == found.params["maxIter"]
    assert found.cv_score == min(t["score"] for t in found.trials) and len(found.trials) == 4
    with pytest.raises(ValueError, match="stopping rule"):
        models.early_stopped_search(rows, "y", est, {"maxIter": [3]})


def test_a_search_starts_from_the_best_earlier_run(spark, rows, tmp_path):
    root = str(tmp_path / "runs")
    for run, depth, r2 in (("a~1", 2, 0.2), ("a~2", 5, 0.9), ("b~1", 7, 0.99)):
        sinks.log_run(sinks.run_rows(spark, run, {"learner": "tree", "maxDepth": depth, "gone": 1}, {"y_r2": r2}), root)
    start = sinks.earlier_best(spark.read.parquet(root), "a~")
    assert start == {"learner": ["tree"], "maxDepth": ["5"], "gone": ["1"]}
    several = {
        "linear": (LinearRegression(), {"regParam": [0.0]}),
        "tree": (DecisionTreeRegressor(seed=1), {"maxDepth": [1, 5]}),
    }
    found = models.fit_tuned(rows, "y", learners=several, start=start)
    assert [(t["learner"], t.get("maxDepth")) for t in found.trials] == [("tree", 5), ("tree", 1), ("linear", None)]
    plain = models.fit_tuned(rows, "y", learners=several)
    assert sorted(t["score"] for t in plain.trials) == pytest.approx(sorted(t["score"] for t in found.trials))
    outside = models.fit_tuned(rows, "y", learners=several, start={**start, "maxDepth": ["4", "6"]})
    assert [t.get("maxDepth") for t in outside.trials] == [4, 6, 1, 5, None]
    other = models.fit_tuned(rows, "y", learners=several, start={"learner": ["gone"], "maxDepth": ["3"]})
    assert [t["learner"] for t in other.trials] == ["linear", "tree", "tree"]
    assert sinks.earlier_best(spark.read.parquet(root), "c~") == {}


def test_training_starts_from_its_stored_runs(spark, tmp_path):
    from terracell.functions import grid

    at = spark.range(150).withColumns({"lat": 4.0 + (F.col("id") % 15) * 0.5, "long": 3.0 + F.floor(F.col("id") / 15) * 0.5})
    cells = at.select(
        grid.cell_of("lat", "long", 5).alias("hex_code"),
        ((F.col("id") * 37 % 41) / 41.0).alias("x"),
        F.lit(50).alias("survey"),
        F.pow((F.col("id") * 37 % 41) / 41.0, 2).alias("dep_housing_sev"),
    ).dropDuplicates(["hex_code"])

    def config(**options):
        return training.TrainConfig(
            "Testland", 5, 30, "housing", k=2, learners={"forest": (RandomForestRegressor(seed=1, numTrees=3), options)}
        )

    first = training.train(cells, config(maxDepth=[1, 6]))
    training.save_run(first, config(), str(tmp_path))
    again = training.train(cells, config(maxDepth=[2]), spark.read.parquet(f"{tmp_path}/runs"))
    trials = again["dep_housing_sev"].result.trials
    assert [t["maxDepth"] for t in trials] == [first["dep_housing_sev"].result.params["maxDepth"], 2]


def test_geojson_outlines(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2.5, 7], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]
    kinds = [("Polygon", [square, hole]), ("MultiPolygon", [[square], [hole]]), ("Point", [1, 2]), ("Polygon", "broken")]
    features = [{"properties": {"n": i}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(kinds)]
    features.append({"properties": {"n": 4}, "geometry": None})
    (tmp_path / "a.json").write_text(json.dumps({"features": features}, indent=1))
    got = {r["properties"]["n"]: r["parts"] for r in readers.read_geojson(spark, str(tmp_path / "a.json")).collect()}
    plain = {n: p and [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in p] for n, p in got.items()}
    outline, inner = [(v[0], v[1]) for v in square], [tuple(v) for v in hole]
    assert plain == {"0": [[outline, inner]], "1": [[outline], [inner]], "2": None, "3": None, "4": None}


def test_geojson_round_trip(spark, tmp_path):
    texts = ["POLYGON ((0 0, 3 0, 3 2, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6.25, 5 5)))"]
    df = spark.createDataFrame([(i, 'a "b"', t) for i, t in enumerate(texts)], "id int, name string, wkt string")
    df = df.withColumn("parts", geom.parse_wkt("wkt")).withColumn("g", F.lit("x"))
    sinks.write_geojson(df, "parts", ["id", "name"], "g", str(tmp_path / "out"))
    back = readers.read_geojson(spark, f"{tmp_path}/out/*/*.txt").select(F.col("properties")["id"].cast("int").alias("id"), "properties", "parts")
    want = {r["id"]: r["parts"] for r in df.collect()}
    assert {r["id"]: r["parts"] for r in back.collect()} == want
    assert back.first()["properties"]["name"] == 'a "b"'
