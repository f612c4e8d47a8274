import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell.operators import models
from terracell.sources import readers, sinks
from terracell.streaming.landing import land_new_files


def test_survey_csv_by_name_and_missing(spark, tmp_path):
    f = tmp_path / "survey.csv"
    f.write_text("LATNUM,countrycode,survey,sumpoor_sev,location\n1.5,NGA ,s1,,1\nNaN,NGA,s2,2,x\n")
    rows = readers.read_survey(spark, str(f)).orderBy("survey").collect()
    assert rows[0]["latnum"] == 1.5 and rows[0]["sumpoor_sev"] is None and rows[0]["countrycode"] == "NGA "
    assert rows[1]["latnum"] is None and rows[1]["sumpoor_sev"] == 2.0 and rows[1]["location"] is None


def test_tower_gzip_files_all_read_and_bad_lines_dropped(spark, tmp_path):
    good = '"GSM",621,20,1,2,0,3.1,6.2,1,1,1,1,1,-70.5\n'
    for i in range(2):
        with gzip.open(tmp_path / f"nigeria_{i}.csv.gz", "wt") as f:
            f.write(good + "GSM,not-a-number,x\n")
    rows = readers.read_towers(spark, str(tmp_path / "nigeria_*.csv.gz")).collect()
    assert len(rows) == 2 and rows[0]["radio"] == "GSM" and rows[0]["avg_signal"] == -70.5


def test_zone_road_wealth_geojson(spark, tmp_path):
    z = tmp_path / "zones.csv"
    z.write_text('country,geometry,name,win_population,win_roads_km,area\nNigeria,"POLYGON ((0 0, 1 0, 1 1, 0 0))",a,1,2,3\n')
    row = readers.read_zones(spark, str(z)).first()
    assert row["geometry"].startswith("POLYGON") and row["area"] == 3.0 and row["zone_id"] is not None
    r = tmp_path / "roads.csv"
    r.write_text("@id\t@lat\t@lon\tlength\thighway\n5\t1.0\t2.0\t30.5\tprimary\n")
    assert readers.read_roads(spark, str(r)).first()["length"] == 30.5
    w = tmp_path / "wealth.csv"
    w.write_text("quadkey,rwi,error\n0012,0.5,0.1\n")
    assert readers.read_wealth(spark, str(w)).first()["quadkey"] == "0012"
    g = tmp_path / "a.json"
    g.write_text('{"features":[{"properties":{"name":"x"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    row = readers.read_geojson(spark, str(g)).first()
    assert row["properties"]["name"] == "x" and row["coordinates"].replace(" ", "") == "[1,2]"


def test_datasets_round_trip_replaces_only_its_partition(spark, tmp_path):
    root = str(tmp_path / "hexes")
    df = spark.createDataFrame([(1, 0.5)], "hex_code long, x double")
    sinks.write_dataset(df, root, "Kenya", 7, 30)
    sinks.write_dataset(df.withColumn("x", F.lit(0.7)), root, "Nigeria", 7, 30)
    sinks.write_dataset(df.withColumn("x", F.lit(0.9)), root, "Kenya", 7, 30)
    got = {r["country"]: r["x"] for r in readers.read_datasets(spark, root, 7, 30).collect()}
    assert got == {"kenya": 0.9, "nigeria": 0.7}
    assert readers.read_datasets(spark, root, 7, 30, ["Kenya"]).count() == 1


def test_materialize_builds_once_unless_forced(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert sinks.materialize(spark, str(tmp_path), "t", build, force).count() == 3
    assert len(calls) == 2


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i, r2 in enumerate((0.2, 0.6)):
        sinks.log_run(
            sinks.run_rows(spark, f"nga-{i}", {"depth": i}, {"water_r2": r2}, {"system.x": 1, "cv": "normal"}, ("m",)), path
        )
    table = spark.read.parquet(path)
    got = sinks.fetch_run(table, "nga-1")
    assert [r["key"] for r in got["tags"].collect()] == ["cv"] and got["artifacts"].count() == 1
    assert sinks.best_params(table, "nga").first()["text"] == "1"


def test_run_key_round_trip():
    key = models.RunKey("Nigeria", 7, 30, "dep_water_sev", "spatial", "median", "robust", True)
    assert models.RunKey.parse(key.text()).text() == key.text()
    assert models.target_columns("av-severity") == ["sumpoor_sev"] and len(models.target_columns()) == 7
    with pytest.raises(ValueError):
        models.target_columns("nope")


def test_landing_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = T.StructType([T.StructField("a", T.IntegerType())])
    where = (str(tmp_path / "out"), str(tmp_path / "mark"))
    for n in range(3):
        if n < 2:
            (src / f"f{n}.csv").write_text(f"{n}\n")
        land_new_files(spark, str(src), kind, *where)
    assert sorted(r["a"] for r in spark.read.parquet(where[0]).collect()) == [0, 1]
