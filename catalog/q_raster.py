"""Raster and image-collection queries on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import sql_axial, v_imagery, v_patch, v_pixel, v_raster, v_site, v_zone, with_views
from terracell.functions import geom
from terracell.operators import imagery as img
from terracell.operators import raster as ras

B = ["b1", "b2"]


def clean(spark, d):
    return ras.mask_nodata(v_pixel(spark, d), v_raster(spark, d), B)


def off_edge(spark, d):
    """Sites moved a little, so that none lies exactly on a pixel edge."""
    return v_site(spark, d).select(
        "c_custkey", (F.col("lat") + 0.00037).alias("lat"), (F.col("lon") + 0.00041).alias("long")
    )


@query(
    "S10 S11 R1 E9 P4 P13",
    with_views(
        ["v_pixel_at"],
        "SELECT round(lat, 6) AS latitude, round(long, 6) AS longitude, b1, b2 FROM v_pixel_at WHERE b1 IS NOT NULL AND b2 IS NOT NULL",
    ),
)
def raster_frame(spark, d):
    return rounded(ras.raster_frame(v_pixel(spark, d), v_raster(spark, d), B))


@query(
    "R3 E9 G1 Y1",
    with_views(
        ["v_pixel_at"],
        f"""SELECT hex_code, round(avg(b1), 6) AS b1, round(avg(b2), 6) AS b2 FROM (
        {sql_axial('lat', 'long', 4, '(SELECT * FROM v_pixel_at WHERE b1 IS NOT NULL AND b2 IS NOT NULL)')}) GROUP BY hex_code""",
    ),
)
def raster_to_cells(spark, d):
    return rounded(ras.cells_from_raster(v_pixel(spark, d), v_raster(spark, d), B, 4))


@query(
    "R4 P24 S12 Y1",
    with_views(
        ["v_pixel_at"],
        f"""SELECT hex_code, round(max(b1), 6) AS b1, round(max(b2), 6) AS b2 FROM (
        {sql_axial('lat', 'long', 4, '(SELECT * FROM v_pixel_at WHERE b1 IS NOT NULL OR b2 IS NOT NULL)')}) GROUP BY hex_code""",
    ),
)
def bands_to_cells(spark, d):
    long = ras.to_long(v_pixel(spark, d), B)
    return rounded(ras.cells_from_bands(long, v_raster(spark, d), B, 4, agg_fn=F.max))


@query(
    "R1 P4",
    with_views(["v_pixel"], "SELECT raster, row, col, b1, b2 FROM v_pixel WHERE b1 IS NOT NULL AND b2 IS NOT NULL"),
)
def long_to_wide(spark, d):
    return rounded(ras.to_wide(ras.to_long(clean(spark, d), B), B))


@query(
    "A28 R5 P25 J4",
    with_views(
        ["v_site", "v_pixel_at"],
        f"""SELECT c.hex_code, b1, b2 FROM (SELECT DISTINCT hex_code FROM ({sql_axial('lat', 'lon', 4, 'v_site')})) c LEFT JOIN (
        SELECT hex_code, round(sum(b1), 6) AS b1, round(sum(b2), 6) AS b2 FROM (
        {sql_axial('lat', 'long', 4, '(SELECT * FROM v_pixel_at WHERE b1 IS NOT NULL OR b2 IS NOT NULL)')}) GROUP BY hex_code) a ON c.hex_code = a.hex_code""",
    ),
)
def raster_sums_on_cells(spark, d):
    from catalog.q_grid import site_cells

    px, meta = v_pixel(spark, d), v_raster(spark, d)
    both = ras.cells_from_raster(px, meta, B, 4, agg_fn=F.sum, null_policy="per_band")
    base = site_cells(spark, d, 4).withColumn("b1", F.lit(0.0))
    return rounded(ras.attach_rasters(base, [(both, ["b1"]), (both, ["b2"])]))


@query(
    "R2 F2 P24",
    """SELECT l_returnflag AS raster, cast(n AS BIGINT) AS n, position, CASE WHEN l_returnflag = 'N' THEN 'ndvi' ELSE 'ndvi_' || (position + 1) END AS band
    FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT cast(range AS BIGINT) AS position FROM range(2))
    WHERE l_returnflag <> 'N' OR position = 0""",
)
def raster_band_names(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    meta = li.select(
        F.col("l_returnflag").alias("raster"),
        "n",
        F.when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long").alias("n_bands"),
        F.lit("img_ndviData_kenya_500.tif").alias("title"),
    )
    names = ras.band_names(meta, title="title", strip=r"img|_|kenya|500")
    return rounded(names.join(meta.select("raster", "n"), "raster"))


@query(
    "R13 P21",
    with_views(
        ["v_pixel"],
        """SELECT raster, 'EPSG:4326' AS crs, -9999e0 AS nodata, cast(150 AS BIGINT) AS width, max(row) + 1 AS height, cast(2 AS BIGINT) AS n_bands,
        0.08e0 AS x_resolution, round(9.6e0 / (max(row) + 1), 6) AS y_resolution FROM v_pixel GROUP BY raster""",
    ),
)
def raster_report(spark, d):
    small, _ = ras.route_by_bands(v_raster(spark, d), 3)
    return rounded(ras.metadata_report(ras.refuse_wide(small, 5)))


@query(
    "R6 Q2 Q8 S13",
    with_views(
        ["v_pixel_at", "v_zone"],
        "SELECT row, col, b1, b2 FROM v_pixel_at p WHERE EXISTS (SELECT 1 FROM v_zone WHERE country = 'AFRICA' AND long >= x0 AND long < x1 AND lat >= y0 AND lat < y1)",
    ),
)
def raster_clip(spark, d):
    zone = v_zone(spark, d).filter(F.col("country") == "AFRICA")
    return ras.clip_to_area(clean(spark, d), v_raster(spark, d), zone, "zone_id").select("row", "col", *B)


@query(
    "R6",
    with_views(
        ["v_pixel_at", "v_zone"],
        """SELECT min(row) AS row0, min(col) AS col0, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width,
        round(2.7e0 + 0.08e0 * min(col), 6) AS c FROM v_pixel_at p WHERE EXISTS (SELECT 1 FROM v_zone WHERE country = 'AFRICA' AND long >= x0 AND long < x1 AND lat >= y0 AND lat < y1)""",
    ),
)
def raster_crop(spark, d):
    zone = v_zone(spark, d).filter(F.col("country") == "AFRICA")
    meta = v_raster(spark, d)
    kept = ras.clip_to_area(v_pixel(spark, d), meta, zone, "zone_id")
    return rounded(ras.crop_metadata(kept, meta).select("row0", "col0", "height", "width", "c"))


@query(
    "R7 R8 R9 Q10 R14",
    with_views(
        ["v_pixel"],
        """SELECT row, col, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS population FROM (
            SELECT t.row, t.col, (CASE WHEN i = 0 THEN 1 - wr ELSE wr END) * (CASE WHEN j = 0 THEN 1 - wc ELSE wc END) AS w, p.b1 AS v
            FROM (SELECT *, floor(fr) AS r0, floor(fc) AS c0, round(fr - floor(fr), 9) AS wr, round(fc - floor(fc), 9) AS wc FROM (
                SELECT *, (row + 0.5e0) * h / (2 * h) - 0.5e0 AS fr, (col + 0.5e0) / 2 - 0.5e0 AS fc FROM (
                SELECT h, unnest(range(0, 2 * h)) AS row FROM (SELECT max(row) + 1 AS h FROM v_pixel)), (SELECT range AS col FROM range(300)))) t,
                range(2) a(i), range(2) b(j), v_pixel p
            WHERE p.row = t.r0 + i AND p.col = t.c0 + j)
        WHERE w > 0 GROUP BY row, col""",
    ),
)
def raster_resample(spark, d):
    meta = v_raster(spark, d)
    out = ras.rename_and_match(clean(spark, d).drop("b2"), meta, {"b1": "population"}, ras.scaled_grid(meta, 2.0))
    return rounded(out.select("row", "col", "population"))


@query(
    "E10 R10 R11",
    with_views(
        ["v_site", "v_pixel"],
        """SELECT c_custkey, s.i, s.j, coalesce(b2, 0) AS b2 FROM (
        SELECT c_custkey, cast(i AS BIGINT) AS i, cast(j AS BIGINT) AS j, cast(floor((lat + 0.00037e0 - 13.8e0) / (-9.6e0 / h)) AS BIGINT) - 2 + i AS row, cast(floor((lon + 0.00041e0 - 2.7e0) / 0.08e0) AS BIGINT) - 2 + j AS col
        FROM v_site, (SELECT max(row) + 1 AS h FROM v_pixel), range(4) a(i), range(4) b(j)) s LEFT JOIN v_pixel p ON p.row = s.row AND p.col = s.col""",
    ),
)
def image_windows(spark, d):
    pts = off_edge(spark, d)
    w = ras.windows_at(pts, clean(spark, d), v_raster(spark, d), ["r1"], ["b2"], 4, 4, key="c_custkey")
    return rounded(w.select("c_custkey", "i", "j", "b2"))


@query(
    "R12",
    with_views(
        ["v_site", "v_pixel"],
        """SELECT c_custkey, string_agg(cast(cast(v AS BIGINT) AS VARCHAR), ',' ORDER BY i, j) AS pixels FROM (SELECT c_custkey, s.i, s.j, coalesce(b2, 0) AS v FROM (
        SELECT c_custkey, i, j, cast(floor((lat + 0.00037e0 - 13.8e0) / (-9.6e0 / h)) AS BIGINT) - 1 + i AS row, cast(floor((lon + 0.00041e0 - 2.7e0) / 0.08e0) AS BIGINT) - 1 + j AS col
        FROM v_site, (SELECT max(row) + 1 AS h FROM v_pixel), range(3) a(i), range(3) b(j)) s LEFT JOIN v_pixel p ON p.row = s.row AND p.col = s.col) GROUP BY c_custkey""",
    ),
)
def image_stack(spark, d):
    pts = off_edge(spark, d)
    w = ras.windows_at(pts, clean(spark, d), v_raster(spark, d), ["r1"], ["b2"], 3, 3, key="c_custkey")
    s = ras.stack_windows(w, ["b2"], key="c_custkey")
    return s.select("c_custkey", F.array_join(F.transform("pixels", lambda v: v.cast("long").cast("string")), ",").alias("pixels"))


@query(
    "R15",
    with_views(
        ["v_pixel_at"],
        f"""SELECT hex_code, round(avg(b2) * 25 * 20.6e0, 6) AS population FROM ({sql_axial('lat', 'long', 4, 'v_pixel_at')}) WHERE b2 IS NOT NULL GROUP BY hex_code""",
    ),
)
def population_scale(spark, d):
    cells = ras.cells_from_raster(v_pixel(spark, d), v_raster(spark, d), ["b2"], 4)
    return rounded(ras.scale_population(cells, "b2").select("hex_code", "population"))


@query(
    "Q9",
    with_views(
        ["v_pixel"],
        """SELECT o.row, o.col, round(degrees(atan(sqrt(pow((e.b1 - w.b1) / (2 * 0.08e0), 2) + pow((n.b1 - s.b1) / (2 * 9.6e0 / h), 2)))), 6) AS slope
        FROM (SELECT *, (SELECT max(row) + 1 FROM v_pixel) AS h FROM v_pixel WHERE b1 IS NOT NULL) o
        LEFT JOIN v_pixel e ON e.row = o.row AND e.col = o.col + 1 LEFT JOIN v_pixel w ON w.row = o.row AND w.col = o.col - 1
        LEFT JOIN v_pixel n ON n.row = o.row - 1 AND n.col = o.col LEFT JOIN v_pixel s ON s.row = o.row + 1 AND s.col = o.col""",
    ),
)
def terrain_slope(spark, d):
    return rounded(ras.slope_degrees(clean(spark, d), v_raster(spark, d), "b1").drop("raster"))


IMG = "collection, band, row, col"


@query(
    "Q1 Q3 Q4 Q5",
    with_views(
        ["v_imagery"],
        f"""SELECT {IMG}, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM v_imagery
        WHERE ts >= '1995-01-01' AND ts < '1997-01-01' GROUP BY {IMG}""",
    ),
)
def image_mean_std(spark, d):
    chosen = img.select_bands(img.between_dates(v_imagery(spark, d), "1995-01-01", "1997-01-01"), ["q"])
    m, s = img.mean_over_time(chosen, "mean"), img.stddev_over_time(chosen, "std")
    return rounded(m.join(s, img.PIXEL))


@query(
    "Q6 T4",
    with_views(
        ["v_imagery"],
        f"SELECT {IMG}, round(avg(value), 6) AS value FROM v_imagery WHERE ts = (SELECT max(ts) FROM v_imagery) GROUP BY {IMG}",
    ),
)
def image_latest(spark, d):
    return rounded(img.latest_image(v_imagery(spark, d)))


@query(
    "Q7",
    with_views(
        ["v_imagery"],
        f"""SELECT {IMG}, round(avg(v), 6) AS value FROM (SELECT {IMG}, month(ts) AS m, avg(value) AS v FROM v_imagery GROUP BY {IMG}, month(ts)) GROUP BY {IMG}""",
    ),
)
def image_monthly(spark, d):
    return rounded(img.monthly_climatology(v_imagery(spark, d)))


@query(
    "Q11 Q10",
    with_views(
        ["v_imagery"],
        """SELECT 'rain' AS product, band, row, col, round(cast(cast(avg(v) AS FLOAT) AS double), 4) AS value FROM (
        SELECT band, row, col, month(ts) AS m, avg(value) AS v FROM v_imagery WHERE ts >= '1994-01-01' AND ts < '1999-01-01' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4
        UNION ALL SELECT 'total', band, row, col, round(cast(cast(avg(value) AS FLOAT) AS double), 4) FROM v_imagery WHERE ts >= '1994-01-01' AND ts < '1999-01-01' GROUP BY 1, 2, 3, 4
        UNION ALL SELECT 'spread', band, row, col, round(cast(cast(stddev_pop(value) AS FLOAT) AS double), 4) FROM v_imagery WHERE ts >= '1994-01-01' AND ts < '1999-01-01' GROUP BY 1, 2, 3, 4""",
    ),
)
def image_products(spark, d):
    span = ("1994-01-01", "1999-01-01")
    wanted = [
        img.Product("rain", "c1", ("q",), "monthly", *span),
        img.Product("total", "c1", ("q",), "mean", *span),
        img.Product("spread", "c1", ("q",), "stddev", *span),
    ]
    return img.build_products(v_imagery(spark, d), wanted).withColumn("value", F.round("value", 4))


@query(
    "E10 E11",
    with_views(
        ["v_site"],
        "SELECT c_custkey, cast(floor((lat + 0.00037e0 - 13.8e0) / -0.096e0) AS BIGINT) AS row, cast(floor((lon + 0.00041e0 - 2.7e0) / 0.08e0) AS BIGINT) AS col FROM v_site",
    ),
)
def pixel_of_point(spark, d):
    s = off_edge(spark, d)
    affine = {"a": 0.08, "b": 0.0, "c": 2.7, "d": 0.0, "e": -0.096, "f": 13.8}
    s = s.withColumns({k: F.lit(v) for k, v in affine.items()}).withColumn("p", geom.pixel_at("long", "lat"))
    return s.select("c_custkey", "p.row", "p.col")


def product_list() -> list[tuple[str, str, int, bool]]:
    """(collection, band, factor, dated) of every band that the product list names."""
    named = {}
    for p in img.PRODUCTS:
        for band in p.bands:
            named.setdefault((p.collection, band), p.start is not None)
    return [(c, b, i + 1, dated) for i, ((c, b), dated) in enumerate(named.items())]


def product_sql() -> str:
    """Each product by its own reducer; dated images lie 20 years later, undated ones have no time."""
    rows = ", ".join(f"('{c}', '{b}', {f}, {str(dated).lower()})" for c, b, f, dated in product_list())
    images = f"""SELECT n.c AS collection, n.b AS band, CASE WHEN dated THEN ts + INTERVAL 20 YEAR END AS ts, row, col, value * f AS value
        FROM v_imagery, (VALUES {rows}) n(c, b, f, dated)"""
    parts = []
    for p in img.PRODUCTS:
        bands = ", ".join(f"'{b}'" for b in p.bands)
        dates = f" AND ts >= '{p.start}' AND ts < '{p.end}'" if p.start else ""
        source = f"(SELECT * FROM images WHERE collection = '{p.collection}' AND band IN ({bands}){dates})"
        newest = f"(SELECT band, row, col, avg(value) AS v FROM {source} WHERE ts IS NOT DISTINCT FROM (SELECT max(ts) FROM {source}) GROUP BY 1, 2, 3)"
        value, at = {
            "mean": (f"(SELECT band, row, col, avg(value) AS v FROM {source} GROUP BY 1, 2, 3)", "band"),
            "stddev": (f"(SELECT band, row, col, stddev_pop(value) AS v FROM {source} GROUP BY 1, 2, 3)", "band"),
            "monthly": (f"(SELECT band, row, col, avg(v) AS v FROM (SELECT band, row, col, avg(value) AS v FROM {source} GROUP BY 1, 2, 3, month(ts)) GROUP BY 1, 2, 3)", "band"),
            "latest": (newest, "band"),
            "slope": (
                f"""(SELECT o.row, o.col, degrees(atan(sqrt(pow((e.v - w.v) / (2 * 0.08e0), 2) + pow((n.v - s.v) / (2 * 0.08e0), 2)))) AS v
                FROM {newest} o LEFT JOIN {newest} e ON e.row = o.row AND e.col = o.col + 1 LEFT JOIN {newest} w ON w.row = o.row AND w.col = o.col - 1
                LEFT JOIN {newest} n ON n.row = o.row - 1 AND n.col = o.col LEFT JOIN {newest} s ON s.row = o.row + 1 AND s.col = o.col)""",
                "'slope'",
            ),
        }[p.reducer]
        parts.append(f"SELECT '{p.name}' AS product, {at} AS band, row, col, round(cast(cast(v AS FLOAT) AS double), 3) AS value FROM {value}")
    return with_views(["v_imagery"], " UNION ALL ".join(parts), [("images", images)])


@query("Q11 R2 S11", product_sql())
def product_list_rows(spark, d):
    """Every product of the list, over collections made from the given imagery."""
    names = F.array(
        *[F.struct(F.lit(c).alias("c"), F.lit(b).alias("b"), F.lit(f).alias("f"), F.lit(dated).alias("dated")) for c, b, f, dated in product_list()]
    )
    images = v_imagery(spark, d).withColumn("n", F.explode(names))
    later = F.col("ts") + F.make_ym_interval(F.lit(20))
    images = images.select(
        F.col("n.c").alias("collection"), F.col("n.b").alias("band"), F.when(F.col("n.dated"), later).alias("ts"),
        "row", "col", (F.col("value") * F.col("n.f")).alias("value"),
    )
    meta = v_raster(spark, d).withColumns({"raster": F.lit("elevation"), "e": F.lit(-0.08)})
    return img.build_products(images, meta=meta).withColumn("value", F.round("value", 3))


@query(
    "X17",
    with_views(
        ["v_patch"],
        """SELECT hex_code, round(sum(coalesce(v, CASE WHEN m < 0 THEN 2 * m ELSE -2 * m END)), 4) AS total FROM (
        SELECT hex_code, unnest(pixels)::double AS v FROM v_patch) p, (SELECT min(v) AS m FROM (SELECT unnest(pixels)::double AS v FROM v_patch)) GROUP BY hex_code""",
    ),
)
def patch_fill(spark, d):
    from terracell.operators.encode import fill_patches

    p = fill_patches(v_patch(spark, d))
    return p.select("hex_code", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))
