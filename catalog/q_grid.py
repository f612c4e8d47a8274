"""Grid, geometry and spatial-join queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import (
    lit,
    sql_area,
    sql_axial,
    sql_cell_lat,
    sql_cell_long,
    sql_disk,
    sql_q,
    sql_r,
    v_conflict,
    v_site,
    v_survey,
    v_tile,
    v_tile_wkt,
    v_zone,
    with_views,
)
from terracell.functions import geom, grid
from terracell.functions.grid import EARTH_KM, SQRT3, cell_radius_km
from terracell.operators import spatial
from terracell.plans import features as feat

SITES4 = ("cells", f"SELECT DISTINCT hex_code FROM ({sql_axial('lat', 'lon', 4, 'v_site')})")


def site_cells(spark, d, res=4):
    return v_site(spark, d).select(grid.cell_of("lat", "lon", res).alias("hex_code")).distinct()


def sql_cover(res: int, source: str = "v_zone", key: str = "zone_id") -> str:
    """Cells of box zones: every axial position over the whole extent, kept when its centre is inside."""
    s = cell_radius_km(res)
    r0, r1 = (int(EARTH_KM * math.sin(math.radians(v)) / (1.5 * s)) + pad for v, pad in ((3, -2), (15, 2)))
    q_hi = int(EARTH_KM * math.radians(18) / (s * SQRT3)) + 2
    q_lo = -q_hi
    return f"""SELECT {key}, {res * (1 << 56)} + (q + 134217728) * 268435456 + (r + 134217728) AS hex_code
        FROM (SELECT q, r, degrees(asin(1.5e0 * {lit(s)} * r / {lit(EARTH_KM)})) AS lat,
            degrees({lit(s)} * {lit(SQRT3)} * (q + r / 2e0) / {lit(EARTH_KM)}) AS long
            FROM range({q_lo}, {q_hi}) a(q), range({r0}, {r1}) b(r)) c
        JOIN {source} z ON c.long >= z.x0 AND c.long < z.x1 AND c.lat >= z.y0 AND c.lat < z.y1"""


@query(
    "G1 G2 G12 G13 E12 E13",
    with_views(
        ["v_site"],
        f"""SELECT c_custkey, hex_code, lower(to_hex(hex_code)) AS cell_text, hex_code AS back,
        round({sql_cell_lat('hex_code', 5)}, 6) AS clat, round({sql_cell_long('hex_code', 5)}, 6) AS clong,
        lat AS plat, lon AS plong
        FROM ({sql_axial('lat', 'lon', 5, 'v_site')})""",
    ),
)
def cell_and_centroid(spark, d):
    s = v_site(spark, d).withColumn("hex_code", grid.cell_of("lat", "lon", 5))
    return rounded(
        s.withColumn("p", geom.point("lon", "lat")).select(
            "c_custkey",
            "hex_code",
            grid.cell_text("hex_code").alias("cell_text"),
            grid.cell_from_text(grid.cell_text("hex_code")).alias("back"),
            grid.cell_centroid("hex_code")["lat"].alias("clat"),
            grid.cell_centroid("hex_code")["long"].alias("clong"),
            geom.point_lat("p").alias("plat"),
            geom.point_long("p").alias("plong"),
        )
    )


@query(
    "G13",
    with_views(
        ["v_site"],
        f"""SELECT hex_code AS coarse, count(*) AS n FROM ({sql_axial('clat', 'clong', 2, f'''(SELECT
        {sql_cell_lat("hex_code", 5)} AS clat, {sql_cell_long("hex_code", 5)} AS clong FROM ({sql_axial("lat", "lon", 5, "v_site")}))''')})
        GROUP BY hex_code""",
    ),
)
def coarser_cells(spark, d):
    s = v_site(spark, d).select(grid.coarser(grid.cell_of("lat", "lon", 5), 2).alias("coarse"))
    return s.groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))


@query(
    "G3",
    with_views(
        ["v_site"],
        " UNION ALL ".join(
            f"""SELECT hex_code, cast({i} AS BIGINT) AS i,
            round(degrees(({lit(cell_radius_km(4))} * {lit(SQRT3)} * ({sql_q('hex_code')} + {sql_r('hex_code')} / 2e0)
                + {lit(cell_radius_km(4) * math.cos(math.radians(30 + 60 * (i % 6))))}) / {lit(EARTH_KM)}), 6) AS x,
            round(degrees(asin((1.5e0 * {lit(cell_radius_km(4))} * {sql_r('hex_code')}
                + {lit(cell_radius_km(4) * math.sin(math.radians(30 + 60 * (i % 6))))}) / {lit(EARTH_KM)})), 6) AS y FROM cells"""
            for i in range(7)
        ),
        [SITES4],
    ),
)
def cell_boundary(spark, d):
    c = site_cells(spark, d)
    out = c.select("hex_code", F.posexplode(grid.cell_boundary("hex_code", 4)).alias("i", "p"))
    return rounded(out.select("hex_code", "i", "p.x", "p.y"))


@query(
    "G4 G6",
    with_views(
        ["v_site"],
        f"""SELECT hex_code, o.dist AS distance, hex_code + o.step AS nbr FROM cells, {sql_disk(2)} o WHERE o.dist > 0""",
        [SITES4],
    ),
)
def ring_cells(spark, d):
    c = site_cells(spark, d)
    out = c.select("hex_code", F.explode(grid.ring_distances("hex_code", 2)).alias("n"))
    return out.select("hex_code", "n.distance", F.col("n.hex_code").alias("nbr")).filter(
        grid.grid_distance("hex_code", "nbr") == F.col("distance")
    )


@query(
    "G7 J13 U3 U4",
    with_views(
        ["v_site"],
        f"SELECT DISTINCT hex_code + o.step AS hex_code FROM cells, {sql_disk(2)} o EXCEPT SELECT hex_code FROM cells",
        [SITES4],
    ),
)
def new_neighbours(spark, d):
    return spatial.new_neighbours(site_cells(spark, d), 2)


@query(
    "G10 G11",
    with_views(
        [],
        " UNION ALL ".join(
            f"SELECT l_linenumber, count(*) AS n, {sql_area(r)} AS area_km2, round({lit(cell_radius_km(r))}, 6) AS radius_km FROM line WHERE l_linenumber = {r} GROUP BY l_linenumber"
            for r in range(1, 8)
        ),
        [("line", "SELECT cast(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")],
    ),
)
def cell_area_and_radius(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    radii = F.array(*[F.lit(cell_radius_km(r)) for r in range(16)])
    return rounded(
        li.select(
            "l_linenumber", "n", grid.cell_area_km2("l_linenumber").alias("area_km2"), F.get(radii, F.col("l_linenumber")).alias("radius_km")
        )
    )


@query("G8 G9 E1 E3 J6 P9 Z3", with_views(["v_zone"], sql_cover(4)))
def zone_cells(spark, d):
    return spatial.cover_cells(v_zone(spark, d), "zone_id", 4)


@query(
    "Z3 J6 P9 S5",
    with_views(
        ["v_zone"],
        f"""SELECT c.hex_code, z.name AS name_commuting, cast(z.zone_id AS BIGINT) AS zone_id_commuting FROM ({sql_cover(4)}) c JOIN v_zone z USING (zone_id)
        WHERE z.country = 'AFRICA'""",
    ),
)
def commuting_zones(spark, d):
    return rounded(
        feat.commuting_zones(v_zone(spark, d), "AFRICA", 4, key="zone_id").select(
            "hex_code", "name_commuting", "zone_id_commuting"
        )
    )


@query(
    "G14 U2",
    with_views(
        ["v_zone"],
        f"SELECT DISTINCT hex_code + o.step AS hex_code FROM ({sql_cover(4)}) c JOIN v_zone z USING (zone_id), {sql_disk(2)} o WHERE z.country = 'ASIA'",
    ),
)
def base_cells(spark, d):
    return feat.base_cells(v_zone(spark, d), "ASIA", 4, name="country", key="zone_id")


@query(
    "S13 S14 P19 E5 J11",
    with_views(
        ["v_zone", "v_site"],
        "SELECT c_custkey, cast(zone_id AS BIGINT) AS zone_id FROM v_site, v_zone WHERE lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1",
    ),
)
def points_in_zones(spark, d):
    return rounded(
        spatial.points_in_areas(v_site(spark, d), v_zone(spark, d), "zone_id", x="lon").select("c_custkey", "zone_id")
    )


@query(
    "E2 E4 E6 J5 P19 A8 Z5 S6",
    with_views(
        ["v_tile", "v_zone"],
        f"""SELECT hex_code, round(avg(avg_d_kbps), 6) AS avg_d_kbps, round(avg(avg_u_kbps), 6) AS avg_u_kbps FROM (
        {sql_axial('clat', 'clon', 4, '''(SELECT lat - 0.025e0 AS clat, lon + 0.025e0 AS clon, avg_d_kbps, avg_u_kbps FROM v_tile
            WHERE EXISTS (SELECT 1 FROM v_zone WHERE country = 'EUROPE' AND round(lon, 3) <= x1 AND round(lon + 0.05e0, 3) >= x0 AND round(lat, 3) >= y0 AND round(lat - 0.05e0, 3) <= y1))''')})
        GROUP BY hex_code""",
    ),
)
def speed_by_cell(spark, d):
    """All zones of one country; a tile on the border of two of them counts once."""
    zones = v_zone(spark, d).filter(F.col("country") == "EUROPE")
    return rounded(feat.speed_by_cell(v_tile_wkt(spark, d), zones, "zone_id", 4))


@query(
    "E6 J5",
    with_views(
        ["v_tile", "v_zone"],
        """SELECT p_partkey, cast(zone_id AS BIGINT) AS zone_id FROM v_tile JOIN v_zone
        ON lon <= x1 AND lon + 0.05e0 >= x0 AND lat >= y0 AND lat - 0.05e0 <= y1""",
    ),
)
def tiles_meeting_zones(spark, d):
    t = v_tile(spark, d).select(
        "p_partkey",
        F.col("lon").alias("minx"),
        (F.col("lat") - 0.05).alias("miny"),
        (F.col("lon") + 0.05).alias("maxx"),
        F.col("lat").alias("maxy"),
    )
    return rounded(spatial.boxes_meeting_areas(t, v_zone(spark, d), "zone_id").select("p_partkey", "zone_id"))


@query(
    "E1 E3 E4 E7",
    with_views(
        ["v_zone"],
        f"""SELECT cast(zone_id AS BIGINT) AS zone_id, cast(x0 AS double) AS minx, cast(y1 AS double) AS maxy,
        round((x0 + x1) / 2e0, 6) AS cx, round((y0 + y1) / 2e0, 6) AS cy,
        round({lit(EARTH_KM)} * {lit(EARTH_KM)} * radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0))), 6) AS area_km2 FROM v_zone""",
    ),
)
def zone_measures(spark, d):
    z = v_zone(spark, d).withColumn("g", geom.parse_wkt("geometry"))
    return rounded(
        z.select(
            "zone_id",
            geom.bounds("g")["minx"].alias("minx"),
            geom.bounds("g")["maxy"].alias("maxy"),
            geom.centroid("g")["x"].alias("cx"),
            geom.centroid("g")["y"].alias("cy"),
            geom.area_km2("g").alias("area_km2"),
        )
    )


@query(
    "E8",
    with_views(
        ["v_tile", "v_zone"],
        f"""SELECT p_partkey, cast(zone_id AS BIGINT) AS zone_id, round({lit(EARTH_KM)} * {lit(EARTH_KM)} * radians(least(lon + 2e0, x1) - greatest(lon, x0)) * (sin(radians(least(lat, y1))) - sin(radians(greatest(lat - 2e0, y0)))), 4) AS overlap_km2
        FROM v_tile JOIN v_zone ON lon < x1 AND lon + 2e0 > x0 AND lat > y0 AND lat - 2e0 < y1""",
    ),
)
def zone_overlap_with_tile(spark, d):
    """Area of each zone under a 2 degree window hung on every tile corner."""
    t = v_tile(spark, d).select(
        "p_partkey",
        F.col("lon").alias("minx"),
        (F.col("lat") - 2).alias("miny"),
        (F.col("lon") + 2).alias("maxx"),
        F.col("lat").alias("maxy"),
    )
    z = v_zone(spark, d)
    met = spatial.boxes_meeting_areas(t, z, "zone_id").join(z.select("zone_id", geom.parse_wkt("geometry").alias("g")), "zone_id")
    cut = geom.area_km2(geom.clip_to_box("g", "minx", "miny", "maxx", "maxy"))
    # exploded, so that the area is computed once and not in a filter below, too
    above = F.explode(F.filter(F.array(F.round(cut, 4)), lambda v: v > 0))
    return rounded(met.select("p_partkey", "zone_id", above.alias("overlap_km2")))


@query(
    "E11",
    with_views(
        ["v_site"],
        f"""SELECT c_custkey, round(6378137e0 * radians(lon), 6) AS mx, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS my,
        round({lit(EARTH_KM)} * radians(lon), 6) AS ex, round({lit(EARTH_KM)} * sin(radians(lat)), 6) AS ey,
        lon AS back_x, lat AS back_y FROM v_site""",
    ),
)
def coordinate_systems(spark, d):
    s = v_site(spark, d)
    m = geom.transform_xy("lon", "lat", "EPSG:4326", "EPSG:3857")
    e = geom.transform_xy("lon", "lat", "EPSG:4326", "equal-area-km")
    s = s.withColumns({"m": m, "e": e}).withColumn("b", geom.transform_xy("m.x", "m.y", "EPSG:3857", "EPSG:4326"))
    return rounded(
        s.select(
            "c_custkey",
            F.col("m.x").alias("mx"),
            F.round("m.y", 4).alias("my"),
            F.col("e.x").alias("ex"),
            F.col("e.y").alias("ey"),
            F.col("b.x").alias("back_x"),
            F.col("b.y").alias("back_y"),
        )
    )


@query(
    "E14 E16 U4 U5",
    with_views(
        ["v_site"],
        """SELECT hex_code, string_agg(printf('%.6f', y) || ' ' || printf('%.6f', x), ' ' ORDER BY i) AS coords FROM ("""
        + " UNION ALL ".join(
            f"""SELECT hex_code, {i} AS i,
            degrees(({lit(cell_radius_km(2))} * {lit(SQRT3)} * ({sql_q('hex_code')} + {sql_r('hex_code')} / 2e0)
                + {lit(cell_radius_km(2) * math.cos(math.radians(30 + 60 * i)))}) / {lit(EARTH_KM)}) AS x,
            degrees(asin((1.5e0 * {lit(cell_radius_km(2))} * {sql_r('hex_code')}
                + {lit(cell_radius_km(2) * math.sin(math.radians(30 + 60 * i)))}) / {lit(EARTH_KM)})) AS y FROM cover"""
            for i in range(6)
        )
        + ") GROUP BY hex_code",
        [
            ("coarse", f"SELECT DISTINCT hex_code FROM ({sql_axial('lat', 'lon', 2, 'v_site')})"),
            ("cover", f"SELECT DISTINCT hex_code + o.step AS hex_code FROM coarse, {sql_disk(1)} o"),
        ],
    ),
)
def coarse_cover_text(spark, d):
    return feat.cover_polygons(site_cells(spark, d, 2), 2)


@query(
    "E15",
    with_views(
        ["v_site"],
        """SELECT c_custkey, round(2 * 6371e0 * asin(sqrt(pow(sin(radians(9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(9e0)) * pow(sin(radians(8 - lon) / 2), 2))), 6) AS km FROM v_site""",
    ),
)
def distance_to_centre(spark, d):
    return rounded(v_site(spark, d).select("c_custkey", geom.haversine_km("lat", "lon", F.lit(9.0), F.lit(8.0)).alias("km")))


QUADKEY = "SELECT p_partkey, (p_partkey % 4) || '' || ((p_partkey // 4) % 4) || ((p_partkey // 16) % 4) || ((p_partkey // 64) % 4) || '1' AS quadkey FROM part"


def quadkeys(spark, d):
    k = F.col("p_partkey")
    digit = [F.floor(k / n) % 4 for n in (1, 4, 16, 64)]
    return spark.read.parquet(f"{d}/part.parquet").select(
        k, F.concat(*[x.cast("string") for x in digit], F.lit("1")).alias("quadkey")
    )


@query(
    "G15",
    with_views(
        [],
        """SELECT p_partkey, round(tx / 32e0 * 360 - 180, 6) AS minx, round((tx + 1) / 32e0 * 360 - 180, 6) AS maxx,
        round(degrees(atan(sinh(pi() * (1 - 2 * ty / 32e0)))), 6) AS maxy, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 1) / 32e0)))), 6) AS miny
        FROM (SELECT p_partkey, 16 * (d1 % 2) + 8 * (d2 % 2) + 4 * (d3 % 2) + 2 * (d4 % 2) + 1 AS tx,
            16 * (d1 // 2) + 8 * (d2 // 2) + 4 * (d3 // 2) + 2 * (d4 // 2) AS ty FROM (
            SELECT p_partkey, p_partkey % 4 AS d1, (p_partkey // 4) % 4 AS d2, (p_partkey // 16) % 4 AS d3, (p_partkey // 64) % 4 AS d4 FROM part))""",
    ),
)
def quadkey_tiles(spark, d):
    b = quadkeys(spark, d).withColumn("b", geom.quadkey_box("quadkey"))
    return rounded(b.select("p_partkey", "b.minx", "b.maxx", "b.maxy", "b.miny"))


@query(
    "J10 A10 Z10 G3 G15 E8 S17",
    None,
)
def wealth_by_cell(spark, d):
    """Areal interpolation of a tiled index onto cells; tiles are 0.05 degree boxes."""
    t = v_tile(spark, d).select(
        F.col("lon").alias("minx"),
        (F.col("lat") - 0.05).alias("miny"),
        (F.col("lon") + 0.05).alias("maxx"),
        F.col("lat").alias("maxy"),
        F.col("avg_d_kbps").alias("rwi"),
        F.col("avg_u_kbps").cast("double").alias("error"),
    )
    cells = site_cells(spark, d, 4)
    return rounded(feat.areal_interpolation(cells, t, 4, "rwi", "error"))


@query(
    "P6 A24 J13 V11",
    with_views(
        ["v_site", "v_zone"],
        f"""SELECT 'survey_only' AS side, count(*) AS n FROM (SELECT hex_code FROM cells EXCEPT SELECT hex_code FROM cover)
        UNION ALL SELECT 'cover_only', count(*) FROM (SELECT hex_code FROM cover EXCEPT SELECT hex_code FROM cells)
        UNION ALL SELECT 'both', count(*) FROM (SELECT hex_code FROM cover INTERSECT SELECT hex_code FROM cells)""",
        [SITES4, ("cover", sql_cover(4))],
    ),
)
def reconcile_cells(spark, d):
    from terracell.operators.evaluate import reconcile

    a = site_cells(spark, d, 4)
    b = spatial.cover_cells(v_zone(spark, d), "zone_id", 4).select("hex_code").distinct()
    return reconcile(a, b, "survey", "cover")
