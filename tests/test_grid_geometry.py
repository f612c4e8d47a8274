import math
import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import geom, grid
from terracell.operators import spatial
from terracell.plans import features as feat


def points(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(n)]
    return spark.createDataFrame(rows, "i long, lat double, long double")


@pytest.mark.parametrize("res", [2, 5, 9])
def test_own_cell_has_the_nearest_centre(spark, res):
    p = points(spark).withColumn("cell", grid.cell_of("lat", "long", res))
    near = p.select("i", "lat", "long", "cell", F.explode(grid.disk("cell", 1)).alias("c"))

    def gap():
        dx = grid.project_x("long") - grid.project_x(grid.cell_long("c", res))
        dy = grid.project_y("lat") - grid.project_y(grid.cell_lat("c", res))
        return dx * dx + dy * dy

    best = near.withColumn("d", gap()).groupBy("i", "cell").agg(F.min_by("c", "d").alias("b"))
    assert best.filter("b <> cell").count() == 0


def test_disk_ring_distance_and_text(spark):
    c = points(spark, 20).select(grid.cell_of("lat", "long", 6).alias("c"))
    row = c.select(*[F.size(grid.disk("c", k)).alias(f"d{k}") for k in range(4)], F.size(grid.ring("c", 2)).alias("r2")).first()
    assert [row[f"d{k}"] for k in range(4)] == [1, 7, 19, 37] and row["r2"] == 12
    nbr = c.select("c", F.explode(grid.disk("c", 2)).alias("n"))
    assert nbr.filter(~F.array_contains(grid.disk("n", 2), F.col("c"))).count() == 0
    assert nbr.filter(grid.grid_distance("c", "n") > 2).count() == 0
    assert c.filter(grid.cell_from_text(grid.cell_text("c")) != F.col("c")).count() == 0
    assert c.filter(grid.cell_res("c") != 6).count() == 0


def test_null_coordinates_have_no_cell(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "a double, b double")
    assert df.select(grid.cell_of("a", "b", 5).alias("c")).filter("c IS NOT NULL").count() == 0


def test_boundary_area_matches_table(spark):
    c = points(spark, 30).select(grid.cell_of("lat", "long", 5).alias("c"))
    area = c.select(geom.area_km2(F.array(F.array(grid.cell_boundary("c")))).alias("a"))
    # edges are straight in degrees, so small cells agree closely
    assert area.filter(F.abs(F.col("a") / grid.CELL_AREA_KM2[5] - 1) > 0.01).count() == 0


HOLE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
TWO = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"


def test_wkt_holes_parts_and_refusal(spark):
    df = spark.createDataFrame([(HOLE,), (TWO,)], "g string").withColumn("p", geom.parse_wkt("g"))
    got = df.select(
        F.size("p").alias("parts"),
        geom.contains_point("p", F.lit(1.5), F.lit(1.5)).alias("a"),
        geom.contains_point("p", F.lit(3.0), F.lit(3.0)).alias("b"),
        geom.contains_point("p", F.lit(5.5), F.lit(5.5)).alias("c"),
        geom.planar_area("p").alias("area"),
        geom.centroid("p").alias("m"),
    ).collect()
    assert [(r["parts"], r["a"], r["b"], r["c"], r["area"]) for r in got] == [
        (1, False, True, False, 15.0),
        (2, True, False, True, 5.0),
    ]
    assert got[0]["m"]["x"] == pytest.approx((16 * 2 - 1.5) / 15)
    assert got[1]["m"]["x"] == pytest.approx((4 * 1 + 5.5) / 5)
    bad = spark.createDataFrame([("LINESTRING (0 0, 1 1)",)], "g string")
    with pytest.raises(Exception, match="not a polygon"):
        bad.select(geom.parse_wkt("g")).collect()


def _clip(ring, box):
    """Reference clip in plain Python."""
    for axis, bound, below in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ina, inb = (a[axis] <= bound, b[axis] <= bound) if below else (a[axis] >= bound, b[axis] >= bound)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(a[i] + t * (b[i] - a[i]) for i in (0, 1)))
            if inb:
                out.append(b)
        ring = out
        if not ring:
            return []
    return ring


def _area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if ring else 0.0


def test_areal_interpolation_against_brute_force(spark):
    rng = random.Random(1)
    tiles = []
    for i in range(40):
        x, y = rng.uniform(5, 8), rng.uniform(5, 8)
        tiles.append((x, y, x + 0.7, y + 0.4, float(i), 1.0))
    t = spark.createDataFrame(tiles, "minx double, miny double, maxx double, maxy double, rwi double, error double")
    cells = points_grid(spark, 4)
    got = {r["hex_code"]: r for r in feat.areal_interpolation(cells, t, 4, "rwi", "error").collect()}
    rings = {
        r["hex_code"]: [(p["x"], p["y"]) for p in r["b"]][:-1]
        for r in cells.select("hex_code", grid.cell_boundary("hex_code", 4).alias("b")).collect()
    }
    seen = 0
    for cell, ring in rings.items():
        shares = [(_area(_clip(ring, box[:4])) / _area(ring), box[4]) for box in tiles]
        touching = [(s, v) for s, v in shares if s > 0]
        if touching:
            seen += 1
            assert got[cell]["weighted_rwi"] == pytest.approx(sum(s * v for s, v in touching), abs=1e-9)
            assert got[cell]["rwi"] == pytest.approx(sum(v for _, v in touching) / len(touching))
    assert seen > 20


def points_grid(spark, res):
    rows = [(4.5 + i * 0.1, 4.5 + j * 0.1) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(rows, "lat double, long double")
    return df.select(grid.cell_of("lat", "long", res).alias("hex_code")).distinct()


L_SHAPE = "POLYGON ((2 2, 8 2, 8 4, 4 4, 4 9, 2 9, 2 2))"


def test_cover_and_joins_against_point_tests(spark):
    areas = spark.createDataFrame([(1, L_SHAPE), (2, HOLE), (3, TWO)], "k int, geometry string")
    cover = spatial.cover_cells(areas, "k", 5)
    box = points_box(spark, 5)
    want = (
        box.withColumns({"lat": grid.cell_lat("hex_code", 5), "long": grid.cell_long("hex_code", 5)})
        .join(areas.withColumn("p", geom.parse_wkt("geometry")), F.lit(True))
        .filter(geom.contains_point("p", "long", "lat"))
        .select("k", "hex_code")
    )
    assert cover.count() == cover.distinct().count()
    assert cover.exceptAll(want).count() == 0 and want.exceptAll(cover).count() == 0
    pts = box.withColumns({"lat": grid.cell_lat("hex_code", 5), "long": grid.cell_long("hex_code", 5)})
    for size in (0.3, 1.0, 20.0):
        got = spatial.points_in_areas(pts, areas, "k", size=size).select("k", "hex_code")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def points_box(spark, res):
    ids = spark.range(-400, 400)
    return (
        ids.select(F.col("id").alias("q"))
        .select("q", F.explode(F.sequence(F.lit(-10), F.lit(150))).alias("r"))
        .select(grid.cell_id(res, F.col("q"), F.col("r")).alias("hex_code"))
    )


def test_boxes_meet_areas_once(spark):
    areas = spark.createDataFrame([(1, L_SHAPE), (2, HOLE), (3, TWO)], "k int, geometry string")
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.uniform(-1, 9), rng.uniform(-1, 10)
        rows.append((i, x, y, x + rng.uniform(0.01, 1.5), y + rng.uniform(0.01, 1.5)))
    boxes = spark.createDataFrame(rows, "i int, minx double, miny double, maxx double, maxy double")
    want = (
        boxes.join(areas.withColumn("p", geom.parse_wkt("geometry")), F.lit(True))
        .filter(geom.intersects(geom.box_parts(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]), "p"))
        .select("i", "k")
    )
    for size in (0.5, 3.0):
        got = spatial.boxes_meeting_areas(boxes, areas, "k", size=size).select("i", "k")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_coordinate_systems_and_quadkey(spark):
    row = spark.range(1).select(
        geom.transform_xy(F.lit(10.0), F.lit(20.0), "EPSG:4326", "EPSG:3857").alias("m"),
        geom.quadkey_box(F.lit("03")).alias("q"),
        geom.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("h"),
    ).first()
    assert row["m"]["x"] == pytest.approx(1113194.9079327357)
    assert row["q"]["minx"] == -90.0 and row["q"]["miny"] == pytest.approx(0.0)
    assert row["h"] == pytest.approx(math.pi * 6371)
    with pytest.raises(ValueError):
        geom.transform_xy("a", "b", "EPSG:4326", "EPSG:2154")
