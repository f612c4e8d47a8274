"""Whole jobs and stored tables. Work files go below the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.base import query, rounded
from catalog.fixtures import sql_area, sql_axial, sql_cell_lat, sql_cell_long, sql_disk, with_views
from catalog.q_folds import TRUTH
from catalog.q_grid import sql_cover
from catalog.q_target import FLAGS
from terracell.functions import geom, grid
from terracell.operators import aggregates as agg
from terracell.operators import conformal, models
from terracell.plans import dataset as ds
from terracell.plans import features as feat
from terracell.plans import prediction, training
from terracell.schema import DatasetConfig
from terracell.session import ensure_checkpoint_dir
from terracell.sources import readers, sinks

CONFIG = DatasetConfig("ASIA", "ASIA", res=4, threshold=5)


def work_dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def inputs(spark, d) -> ds.Inputs:
    return ds.Inputs(
        survey=fx.v_survey(spark, d),
        boundaries=fx.v_zone(spark, d),
        boundary_name="country",
        zones=fx.v_zone(spark, d),
        conflicts=fx.v_conflict(spark, d),
        roads=fx.v_road(spark, d),
        speed=fx.v_tile_wkt(spark, d),
        towers=fx.v_tower(spark, d),
        rasters=[ds.RasterInput(fx.v_pixel(spark, d), fx.v_raster(spark, d), ["b1", "b2"])],
    )


_CTES = [
    ("shape_cells", f"SELECT c.hex_code, z.name AS name_commuting FROM ({sql_cover(4)}) c JOIN v_zone z USING (zone_id) WHERE z.country = 'ASIA'"),
    ("cells", f"SELECT DISTINCT hex_code + o.step AS hex_code FROM shape_cells, {sql_disk(2)} o"),
    ("conf", f"SELECT hex_code, count(*) AS n_conflicts FROM ({sql_axial('latitude', 'longitude', 4, chr(40) + 'SELECT * FROM v_conflict WHERE country = ' + chr(39) + 'ASIA' + chr(39) + chr(41))}) GROUP BY 1"),
    ("road", f"SELECT hex_code, sum(length) / 1000e0 / {sql_area(4)} AS road_density FROM ({sql_axial('lat', 'lon', 4, 'v_road')}) GROUP BY 1"),
    (
        "speed",
        f"""SELECT hex_code, avg(avg_d_kbps) AS avg_d_kbps FROM ({sql_axial('clat', 'clon', 4, '''(SELECT lat - 0.025e0 AS clat, lon + 0.025e0 AS clon, avg_d_kbps FROM v_tile
        WHERE EXISTS (SELECT 1 FROM v_zone WHERE country = 'ASIA' AND round(lon, 3) <= x1 AND round(lon + 0.05e0, 3) >= x0 AND round(lat, 3) >= y0 AND round(lat - 0.05e0, 3) <= y1))''')}) GROUP BY 1""",
    ),
    ("tower", f"SELECT hex_code, count(*) FILTER (radio = 'GSM') AS gsm, avg(avg_signal) AS avg_signal FROM ({sql_axial('lat', 'long', 4, 'v_tower')}) GROUP BY 1"),
    ("image", f"SELECT hex_code, avg(b1) AS b1, avg(b2) AS b2 FROM ({sql_axial('lat', 'long', 4, '(SELECT * FROM v_pixel_at WHERE b1 IS NOT NULL AND b2 IS NOT NULL)')}) GROUP BY 1"),
    ("tgt", f"SELECT hex_code, count(survey) AS survey, avg(dep_housing_sev) AS dep_housing_sev, avg(dep_2_or_more_sev) AS dep_2_or_more_sev FROM ({sql_axial('latnum', 'longnum', 4, f'(SELECT *, {FLAGS} FROM v_survey WHERE countrycode = ' + chr(39) + 'ASIA ' + chr(39) + ' AND latnum IS NOT NULL)')}) GROUP BY 1 HAVING count(survey) >= 5"),
]
COMPLETE = ["hex_code", "name_commuting", "n_conflicts", "road_density", "avg_d_kbps", "GSM", "avg_signal", "b1", "b2", "survey", "dep_housing_sev", "dep_2_or_more_sev"]


@query(
    "Z2 Z6 J1 J2 J4 F12 G14 Z3 Z4 Z5",
    with_views(
        ["v_survey", "v_zone", "v_conflict", "v_road", "v_tile", "v_tower", "v_pixel_at"],
        """SELECT c.hex_code, name_commuting, coalesce(n_conflicts, 0) AS n_conflicts, round(coalesce(road_density, 0), 6) AS road_density, round(avg_d_kbps, 6) AS avg_d_kbps,
        coalesce(gsm, 0) AS "GSM", round(avg_signal, 6) AS avg_signal, round(b1, 6) AS b1, round(b2, 6) AS b2, survey, round(dep_housing_sev, 6) AS dep_housing_sev, round(dep_2_or_more_sev, 6) AS dep_2_or_more_sev
        FROM cells c LEFT JOIN shape_cells USING (hex_code) LEFT JOIN conf USING (hex_code) LEFT JOIN road USING (hex_code) LEFT JOIN speed USING (hex_code)
        LEFT JOIN tower USING (hex_code) LEFT JOIN image USING (hex_code) LEFT JOIN tgt USING (hex_code)""",
        _CTES,
    ),
)
def country_dataset(spark, d):
    complete, _ = ds.create_dataset(inputs(spark, d), CONFIG)
    return rounded(complete.select(*COMPLETE))


@query(
    "K1 K2 S15 U1 S8",
    with_views(
        ["v_survey"],
        f"""SELECT 'hexes' AS kind, trim(countrycode) AS country, count(*) AS n, round(sum(h), 4) AS housing FROM (
        SELECT countrycode, hex_code, avg(dep_housing_sev) AS h FROM ({sql_axial('latnum', 'longnum', 3, '(SELECT * FROM v_survey WHERE latnum IS NOT NULL)')}) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 2""",
    ),
)
def stored_datasets(spark, d):
    """Every country's target table written to its partition, then read back as one table."""
    root = work_dir(spark)
    s = fx.v_survey(spark, d).filter("latnum IS NOT NULL").withColumn("hex_code", grid.cell_of("latnum", "longnum", 3))
    t = s.groupBy(F.trim("countrycode").alias("country"), "hex_code").agg(F.count(F.lit(1)).alias("survey"), F.avg("dep_housing_sev").alias("dep_housing_sev"))
    tagged = agg.at_least(t, "survey", 10).withColumns({"res": F.lit(3), "threshold": F.lit(10)})
    sinks.write_table(tagged, root, partition=("country", "res", "threshold"))
    back = readers.read_datasets(spark, root, 3, 10)
    return back.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dep_housing_sev"), 4).alias("housing")).select(
        F.lit("hexes").alias("kind"), F.col("country").cast("string").alias("country"), "n", "housing"
    )


@query(
    "K3 K9 Z4",
    with_views(["v_road"], f"SELECT hex_code, round(sum(length) / 1000e0, 6) AS length_km FROM ({sql_axial('lat', 'lon', 4, 'v_road')}) GROUP BY 1"),
)
def materialized_roads(spark, d):
    root = work_dir(spark)
    keyed = fx.v_road(spark, d).withColumn("hex_code", grid.cell_of("lat", "lon", 4))
    made = sinks.materialize(spark, root, "roads", lambda: agg.density_per_cell(keyed, "length", 4))

    def refuse():
        raise AssertionError("already stored")

    again = sinks.materialize(spark, root, "roads", refuse)
    return rounded(again.join(made.select("hex_code"), "hex_code", "left_semi").select("hex_code", "length_km"))


@query("K8 S10", with_views(["v_pixel"], "SELECT row, col, b1 FROM v_pixel WHERE b1 IS NOT NULL"))
def stored_raster(spark, d):
    from terracell.operators import raster as ras

    root = work_dir(spark)
    meta = fx.v_raster(spark, d)
    clean = ras.mask_nodata(fx.v_pixel(spark, d), meta, ["b1", "b2"])
    sinks.write_raster(ras.to_long(clean, ["b1", "b2"]), meta, root)
    return readers.read_pixels(spark, f"{root}/pixels", ["b1"]).filter("value IS NOT NULL").select("row", "col", F.col("value").alias("b1"))


@query("K12 S6 P8", with_views(["v_tile"], "SELECT round(sum(avg_d_kbps), 4) AS d, cast(sum(avg_u_kbps) AS BIGINT) AS u, count(*) AS n FROM v_tile"))
def stored_tiles(spark, d):
    root = work_dir(spark)
    sinks.write_tiles(fx.v_tile_wkt(spark, d), root)
    t = readers.read_table(spark, root)
    return t.agg(F.round(F.sum("avg_d_kbps"), 4).alias("d"), F.sum("avg_u_kbps").alias("u"), F.count("geometry").alias("n"))


@query("K7 K9", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def landed_events(spark, d):
    """Events taken in by a file stream run to the end twice; the second run finds nothing new."""
    from terracell.streaming.landing import land_new_files

    root = work_dir(spark)
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    for _ in range(2):
        land_new_files(spark, d, kind, f"{root}/events", f"{root}/mark", fmt="parquet", options={"pathGlobFilter": "events.parquet"})
    return spark.read.parquet(f"{root}/events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(
    "K10 K11 S18 V3",
    with_views(
        ["v_survey"],
        "SELECT 'dep_housing_r2' AS key, round(1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*)), 6) AS value FROM t UNION ALL SELECT 'dep_housing_rmse', round(sqrt(avg((truth - pred) * (truth - pred))), 6) FROM t UNION ALL SELECT 'dep_housing_mae', round(avg(abs(truth - pred)), 6) FROM t",
        [TRUTH],
    ),
)
def logged_scores(spark, d):
    from catalog.q_folds import truth
    from terracell.operators import evaluate as ev

    root = work_dir(spark)
    sinks.log_run(sinks.run_rows(spark, "run-1", params={"depth": 3}, tags={"system.user": "x", "cv": "normal"}), root)
    sinks.log_run(sinks.score_rows(ev.score(truth(spark, d), "truth", "pred"), "run-1", "dep_housing"), root)
    return rounded(sinks.fetch_run(spark.read.parquet(root), "run-1")["metrics"])


def learners():
    return {
        "linear": (LinearRegression(), {"regParam": [0.01]}),
        "forest": (RandomForestRegressor(seed=1, numTrees=10), {"maxDepth": [4]}),
    }


def trained(spark, d, target="housing", transform="none", cv="normal"):
    complete, _ = ds.create_dataset(inputs(spark, d), CONFIG)
    stored = sinks.materialize(spark, work_dir(spark), "hexes", lambda: training.distinct_cells(complete))
    config = training.TrainConfig(
        "ASIA", 4, 5, target, cv=cv, k=3, learners=learners(), transform=transform, not_features=("name_commuting",)
    )
    return stored, config, training.train(stored, config)


@query("Z7 X13 M3 K13 M14 K10", None)
def trained_and_saved(spark, d):
    trained_cells, config, done = trained(spark, d, transform="power")
    root = work_dir(spark)
    training.save_run(done, config, root)
    runs = spark.read.parquet(f"{root}/runs")
    loaded = models.load_models(spark, runs, f"{root}/models", "asia~%")
    assert set(loaded) == {"dep_housing_sev"}
    again = loaded["dep_housing_sev"].transform(trained_cells)
    assert again.agg(F.max(F.abs("prediction"))).first()[0] <= 1.5  # on the scale of the target
    return rounded(runs.filter("kind = 'metric'").select("run_id", "key", "value"))


@query("Z8 Z9 M15 I3 K4 K5 J17", None)
def predictions_with_bounds(spark, d):
    stored, config, done = trained(spark, d)
    one = done["dep_housing_sev"]
    return rounded(prediction.target_intervals(stored, one.model, "dep_housing_sev", one.test, 4, 0.1))


@query(
    "S2 S3",
    with_views(["v_tower"], "SELECT radio, count(*) AS n, round(sum(avg_signal), 4) AS avg_signal FROM v_tower GROUP BY radio"),
)
def tower_files(spark, d):
    """Towers through headerless quoted gzip files, all files of the folder read back."""
    from terracell.schema import TOWER

    root = work_dir(spark)
    t = fx.v_tower(spark, d)
    have = {"radio", "long", "lat", "avg_signal"}
    full = t.select(*[F.col(f.name) if f.name in have else F.lit(0).cast(f.dataType).alias(f.name) for f in TOWER.fields])
    full.repartition(3).write.option("compression", "gzip").option("quoteAll", True).csv(root)
    back = readers.read_towers(spark, f"{root}/*.csv.gz")
    return back.groupBy("radio").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("avg_signal"), 4).alias("avg_signal"))


@query("S4", with_views(["v_conflict"], "SELECT event_id, country, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM v_conflict"))
def conflict_files(spark, d):
    root = work_dir(spark)
    fx.v_conflict(spark, d).write.option("header", True).csv(root)
    return rounded(readers.read_conflicts(spark, root))


@query("S7", with_views(["v_road"], "SELECT highway, count(*) AS n, round(sum(length), 2) AS length FROM v_road GROUP BY highway"))
def road_files(spark, d):
    root = work_dir(spark)
    r = fx.v_road(spark, d)
    named = r.select(
        F.monotonically_increasing_id().alias("@id"), F.col("lat").alias("@lat"), F.col("lon").alias("@lon"), "length", "highway"
    )
    named.write.option("header", True).option("sep", "\t").csv(root)
    back = readers.read_roads(spark, root)
    return back.groupBy("highway").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 2).alias("length"))


GEOJSON_SQL = """SELECT name, country, CASE WHEN zone_id % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS type,
    CAST(1 + zone_id % 2 AS BIGINT) AS n_parts,
    CAST(x0 AS DOUBLE) AS minx, CAST(y0 AS DOUBLE) AS miny, CAST(x1 AS DOUBLE) AS maxx, CAST(y1 AS DOUBLE) AS maxy,
    CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area,
    CASE WHEN zone_id % 2 = 0 THEN printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', CAST(y0 AS DOUBLE), CAST(x0 AS DOUBLE),
        CAST(y0 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x0 AS DOUBLE)) END AS ring
    FROM v_zone"""


@query("S16", with_views(["v_zone"], GEOJSON_SQL))
def geojson_files(spark, d):
    """Outlines of zones as one GeoJSON document per country, every second zone cut in two parts, all read back."""
    root = work_dir(spark)
    zones = fx.v_zone(spark, d).withColumn("whole", geom.parse_wkt("geometry")).withColumn("box", geom.bounds("whole"))
    b, cut = F.col("box"), F.col("box")["minx"] + 1.0
    halves = F.concat(
        geom.clip_to_box("whole", b["minx"], b["miny"], cut, b["maxy"]),
        geom.clip_to_box("whole", cut, b["miny"], b["maxx"], b["maxy"]),
    )
    zones = zones.withColumn("parts", F.when(F.col("zone_id") % 2 == 0, F.col("whole")).otherwise(halves))
    sinks.write_geojson(zones.withColumn("folder", F.col("country")), "parts", ["name", "country"], "folder", root)
    back = readers.read_geojson(spark, f"{root}/*/*.txt").withColumn("box", geom.bounds("parts"))
    return rounded(
        back.select(
            F.col("properties")["name"].alias("name"),
            F.col("properties")["country"].alias("country"),
            "type",
            F.size("parts").alias("n_parts"),
            *[F.col("box")[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")],
            F.abs(geom.planar_area("parts")).alias("area"),
            F.when(F.col("type") == "Polygon", geom.ring_text(F.col("parts")[0][0])).alias("ring"),
        )
    )
