"""Saved pipelines and splits of the training job."""

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import encode, models, prep
from terracell.plans import training
from terracell.sources import readers


@pytest.fixture(scope="module")
def cells(spark):
    """Targets that rise with one feature: housing by its exponent, water by its square root."""
    at = spark.range(400).withColumns(
        {"lat": 4.0 + (F.col("id") % 20) * 0.4, "long": 3.0 + F.floor(F.col("id") / 20) * 0.4}
    )
    x = (F.col("id") % 40) / 40.0
    return at.select(
        grid.cell_of("lat", "long", 5).alias("hex_code"),
        x.alias("x"),
        F.lit(50).alias("survey"),
        F.exp(-2 * x).alias("dep_housing_sev"),
        F.sqrt(x).alias("dep_water_sev"),
    ).dropDuplicates(["hex_code"])


@pytest.mark.parametrize("transform", ["none", "log", "power"])
def test_saved_pipelines_predict_on_the_scale_of_the_target(spark, cells, tmp_path, transform):
    config = training.TrainConfig(
        "Testland", 5, 30, "housing", k=3, transform=transform, learners={"linear": (LinearRegression(), {"regParam": [0.0]})}
    )
    done = training.train(cells, config)
    training.save_run(done, config, str(tmp_path))
    runs = spark.read.parquet(f"{tmp_path}/runs")
    loaded = models.load_models(spark, runs, f"{tmp_path}/models")["dep_housing_sev"]
    new = cells.withColumns({"lat": grid.cell_lat("hex_code", 5), "long": grid.cell_long("hex_code", 5)})
    got = loaded.transform(new).select("prediction", "dep_housing_sev").collect()
    worst = max(abs(r["prediction"] - r["dep_housing_sev"]) for r in got)
    assert worst < {"none": 0.3, "log": 1e-6, "power": 0.2}[transform]


def test_run_keys_tell_all_options_apart(spark):
    base = dict(country="A", target="housing")
    keys = {
        training.TrainConfig(**base, **other).key("dep_housing_sev").text()
        for other in ({}, {"transform": "power"}, {"holdout": "spatial"}, {"interpretable": True}, {"universal_only": True})
    }
    assert len(keys) == 5
    assert all(models.RunKey.parse(k).text() == k for k in keys)
    twice = spark.createDataFrame([(k,) for k in sorted(keys)], "run_id string")
    with pytest.raises(ValueError, match="several runs"):
        models.load_models(spark, twice, "nowhere")


def test_a_stratified_holdout_follows_each_target(spark, cells, monkeypatch):
    seen = []
    split = training.split
    monkeypatch.setattr(training, "split", lambda df, config, targets: seen.append(list(targets)) or split(df, config, targets))
    monkeypatch.setattr(models, "target_columns", lambda target: ["dep_housing_sev", "dep_water_sev"])
    config = training.TrainConfig(
        "Testland", 5, k=2, holdout="stratified", learners={"linear": (LinearRegression(), {"regParam": [0.0]})}
    )
    assert set(training.train(cells, config)) == {"dep_housing_sev", "dep_water_sev"}
    assert seen == [["dep_housing_sev"], ["dep_water_sev"]]


def test_patches_with_gaps(spark):
    rows = [(i, [float(i), 5.0, float("nan") if i == 0 else 2.0 * i]) for i in range(6)] + [(9, [1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "hex_code long, pixels array<double>")
    got = {r["hex_code"]: r["pixels"] for r in encode.standardize_patches(df).collect()}
    known = [2.0 * i for i in range(1, 6)] + [3.0]
    mean = sum(known) / 6
    sd = (sum((v - mean) ** 2 for v in known) / 6) ** 0.5
    assert got[0][2] is None and got[9][1] is None and got[3][1] == 0.0
    assert got[4][2] == pytest.approx((8.0 - mean) / sd)
    assert encode.encode_patches(df, 2).count() == 7


def test_readers_keep_numbers_and_columns(spark, tmp_path):
    a = tmp_path / "survey.csv"
    a.write_text("location,age,latnum,extra,name\n1.0,3,5.5,2.5,x\n2,4.5,6,,y\n")
    got = readers.read_survey(spark, str(a))
    assert [r["location"] for r in got.collect()] == [1, 2]
    assert [r["extra"] for r in got.collect()] == [2.5, None] and "name" not in got.columns
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text("event_id,country,latitude,longitude\n1,A,1,2\n")
    (tmp_path / "c" / "2.csv").write_text("country,event_id,latitude,longitude\nB,2,1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_conflicts(spark, str(tmp_path / "c")).collect()


def test_inverse_text_equals_the_expression(spark):
    df = spark.createDataFrame([(v / 7,) for v in range(-10, 11)], "prediction double")
    for lam in (0.0, 0.4, 1.0, 2.0):
        power = prep.PowerTarget(lam, 0.2, 0.7)
        both = df.select(power.invert(F.col("prediction")).alias("a"), F.expr(power.invert_sql("prediction")).alias("b"))
        assert all(r["a"] == pytest.approx(r["b"], nan_ok=True) for r in both.collect())
