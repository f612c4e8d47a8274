"""Raster work on pixel tables.

A raster is a pixel table (``raster, row, col`` and one column per band, or long with ``band`` and
``value``) and one metadata row (``raster, crs, a..f, width, height, nodata, n_bands``). Neighbour
and window access never ranges over positions: a pixel is sent to the positions it serves and
meets them by an equal key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import geom, grid
from terracell.operators.spatial import points_in_areas

Agg = Callable[[Column], Column]


def to_long(wide: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("raster", "row", "col")) -> DataFrame:
    return wide.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands]).unpivot(
        list(keys), list(bands), "band", "value"
    )


def to_wide(
    long: DataFrame,
    bands: Sequence[str],
    keys: Sequence[str] = ("raster", "row", "col"),
    null_policy: str = "any",
) -> DataFrame:
    """One column per band. Policy ``any`` drops a pixel missing in some band, ``per_band`` keeps
    it unless every band is missing.

    Pixels are dealt to as many tasks as a shuffle has before they are grouped, so that no task groups all pixels of a file or of
    merged partitions."""
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = long.repartition(tasks, *keys)
    picks = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    return drop_missing(long.groupBy(*keys).agg(*picks), bands, null_policy)


def drop_missing(wide: DataFrame, bands: Sequence[str], null_policy: str) -> DataFrame:
    if null_policy not in ("any", "per_band"):
        raise ValueError(f"unknown null policy: {null_policy}")
    return wide.na.drop("any" if null_policy == "any" else "all", subset=list(bands))


def beside_meta(rows: DataFrame, meta: DataFrame, columns: Sequence[str], by: Sequence[str] = ("row", "col")) -> DataFrame:
    """Rows with columns of their raster's metadata.

    The rows of a raster are dealt to buckets by the hash of ``by`` and its metadata row goes to each bucket, so
    that a large raster is not one task when the join is a shuffle.
    """
    buckets = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    copies = meta.select("raster", *columns, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"))
    return dealt.join(copies, ["raster", "_bucket"]).drop("_bucket")


def mask_nodata(wide: DataFrame, meta: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Null where a band holds its raster's nodata mark."""
    marked = beside_meta(wide, meta, ["nodata"])
    masked = {b: F.when(F.col("nodata").isNull() | (F.col(b) != F.col("nodata")), F.col(b)) for b in bands}
    return marked.withColumns(masked).drop("nodata")


def band_names(
    meta: DataFrame,
    given: Sequence[str] | None = None,
    title: str = "raster",
    strip: str | None = None,
) -> DataFrame:
    """``(raster, position, band)``: embedded names first, then the given list, then the title.

    A one-band raster takes its cleaned title, a many-band one numbers it; a given list of the
    wrong length raises.
    """
    base = clean_title(F.col(title), strip)
    n = F.col("n_bands")
    numbered = F.transform(
        F.sequence(F.lit(1).cast("long"), n),
        lambda i: F.when(n == 1, base).otherwise(F.concat_ws("_", base, i.cast("string"))),
    )
    chosen = numbered
    if given is not None:
        listed = F.array(*[F.lit(g) for g in given])
        chosen = F.when(n == len(given), listed).otherwise(
            F.raise_error(F.lit(f"{len(given)} band names given for another number of bands")).cast("array<string>")
        )
    if "names" in meta.columns:
        chosen = F.coalesce(F.col("names"), chosen)
    return meta.select("raster", F.posexplode(chosen).alias("position", "band"))


def clean_title(title: Column, strip: str | None = None) -> Column:
    """Variable name from a file title."""
    out = F.regexp_replace(title, r"\.tif$", "")
    if strip:
        out = F.regexp_replace(out, strip, "")
    return F.regexp_replace(out, "Data", "")


def metadata_report(meta: DataFrame) -> DataFrame:
    return meta.select(
        "raster",
        "crs",
        "nodata",
        "width",
        "height",
        "n_bands",
        F.abs("a").alias("x_resolution"),
        F.abs("e").alias("y_resolution"),
    )


def route_by_bands(meta: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rasters below the band limit, and the others."""
    return meta.filter(F.col("n_bands") < limit), meta.filter(F.col("n_bands") >= limit)


def refuse_wide(meta: DataFrame, max_bands: int = 5) -> DataFrame:
    """Same table; raises when read if a raster has more bands than allowed."""
    ok = F.assert_true(F.col("n_bands") <= max_bands, F.lit("raster has too many bands"))
    return meta.filter(ok.isNull())


def locate(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Pixels with the geographic ``lat`` and ``long`` of their centres."""
    centre = geom.pixel_centre(None, "row", "col")
    out = beside_meta(pixels, meta, ["crs", *"abcdef"]).withColumns({"_x": centre["x"], "_y": centre["y"]})
    x, y = F.col("_x"), F.col("_y")
    mercator = geom.transform_xy(x, y, "EPSG:3857", "EPSG:4326")
    equal = geom.transform_xy(x, y, "equal-area-km", "EPSG:4326")
    place = (
        F.when(F.col("crs") == "EPSG:4326", F.struct(x.alias("x"), y.alias("y")))
        .when(F.col("crs") == "EPSG:3857", mercator)
        .when(F.col("crs") == "equal-area-km", equal)
        .otherwise(
            F.raise_error(F.concat(F.lit("unsupported coordinate system: "), "crs")).cast("struct<x:double,y:double>")
        )
    )
    return (
        out.withColumn("_g", place)
        .withColumns({"long": F.col("_g.x"), "lat": F.col("_g.y")})
        .drop("crs", *"abcdef", "_x", "_y", "_g")
    )


def raster_frame(pixels: DataFrame, meta: DataFrame, bands: Sequence[str], null_policy: str = "any") -> DataFrame:
    """``latitude, longitude`` and one column per band, nodata masked."""
    clean = drop_missing(mask_nodata(pixels, meta, bands), bands, null_policy)
    at = locate(clean, meta)
    return at.select(F.col("lat").alias("latitude"), F.col("long").alias("longitude"), *bands)


def cells_from_raster(
    pixels: DataFrame,
    meta: DataFrame,
    bands: Sequence[str],
    res: int,
    agg_fn: Agg = F.avg,
    null_policy: str = "any",
) -> DataFrame:
    """Pixels to cells with any aggregate: one map stage and one shuffle on the cell."""
    frame = raster_frame(pixels, meta, bands, null_policy)
    keyed = frame.withColumn("hex_code", grid.cell_of("latitude", "longitude", res))
    return keyed.groupBy("hex_code").agg(*[agg_fn(F.col(b)).alias(b) for b in bands])


def cells_from_bands(
    long: DataFrame, meta: DataFrame, bands: Sequence[str], res: int, agg_fn: Agg = F.avg
) -> DataFrame:
    """The many-band form over a long pixel table, each band skipping its own missing pixels.

    Conditional aggregates instead of a pivot: one shuffle, and the band list bounds the row.
    """
    at = locate(mask_nodata(long, meta, ["value"]).filter(F.col("value").isNotNull()), meta)
    keyed = at.withColumn("hex_code", grid.cell_of("lat", "long", res))
    return keyed.groupBy("hex_code").agg(
        *[agg_fn(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    )


def attach_rasters(base: DataFrame, aggregates: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-attach per-cell raster tables, replacing columns of the same name.

    The tables are stacked and folded to one row per cell, so the base is joined once however
    many rasters there are.
    """
    stacked = None
    names: list[str] = []
    for frame, bands in aggregates:
        names += [b for b in bands if b not in names]
        part = frame.select("hex_code", *bands)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    folded = stacked.groupBy("hex_code").agg(*[F.max(n).alias(n) for n in names])
    return base.drop(*[n for n in names if n in base.columns]).join(folded, "hex_code", "left")


def clip_to_area(pixels: DataFrame, meta: DataFrame, areas: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """Pixels whose centre lies in one of the areas."""
    located = locate(pixels, meta)
    return points_in_areas(located, areas, key, size=size, how="left_semi").select(*pixels.columns)


def crop_metadata(clipped: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of the smallest grid holding the clipped pixels, and its first row and column."""
    box = clipped.groupBy("raster").agg(
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )
    j = meta.join(box, "raster")
    c = F.col("c") + F.col("a") * F.col("col0") + F.col("b") * F.col("row0")
    f = F.col("f") + F.col("d") * F.col("col0") + F.col("e") * F.col("row0")
    return j.withColumns(
        {
            "c": c,
            "f": f,
            "height": F.col("row1") - F.col("row0") + 1,
            "width": F.col("col1") - F.col("col0") + 1,
        }
    ).drop("row1", "col1")


def grid_pixels(meta: DataFrame) -> DataFrame:
    """Every (row, col) of a grid beside its metadata; rows first, so that no array spans the
    raster and the rows are dealt out before the columns are made."""
    rows = meta.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)))
    parts = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "raster", "row").withColumn(
        "col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1))
    )


def match_grid(
    pixels: DataFrame, meta: DataFrame, target: DataFrame, bands: Sequence[str]
) -> DataFrame:
    """Bilinear resampling onto another grid of the same raster name and coordinate system.

    Each target pixel asks for the up to four source pixels around its centre by equal
    (raster, row, col); weights of missing ones are left out and the rest rescaled. The two
    metadata rows are joined before any pixel exists, so the one large join is that with the
    source pixels.
    """
    source = meta.select("raster", F.struct(*"abcdef", "width", "height").alias("_src"))
    grids = target.select("raster", *"abcdef", "width", "height").join(source, "raster")
    centre = geom.pixel_centre(None, "row", "col")
    places = grid_pixels(grids).select("raster", "row", "col", centre["x"].alias("x"), centre["y"].alias("y"), "_src.*")
    spot = geom.pixel_position("x", "y")
    # Plain columns step by step: each is computed once, and generated code stays small.
    at = places.withColumns({"_sr": spot["row"], "_sc": spot["col"]})
    inside = (
        (F.col("_sr") >= 0)
        & (F.col("_sr") <= F.col("height"))
        & (F.col("_sc") >= 0)
        & (F.col("_sc") <= F.col("width"))
    )
    at = at.filter(inside).withColumns(
        {"_r0": F.floor(F.col("_sr") - 0.5), "_c0": F.floor(F.col("_sc") - 0.5)}
    )
    at = at.withColumns(
        {
            "_wr": F.round(F.col("_sr") - 0.5 - F.col("_r0"), 9),
            "_wc": F.round(F.col("_sc") - 0.5 - F.col("_c0"), 9),
        }
    )
    both = F.array(F.lit(0), F.lit(1))
    corners = at.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both))
    share_r = F.when(F.col("_i") == 1, F.col("_wr")).otherwise(F.lit(1.0) - F.col("_wr"))
    share_c = F.when(F.col("_j") == 1, F.col("_wc")).otherwise(F.lit(1.0) - F.col("_wc"))
    asked = corners.select(
        "raster",
        "row",
        "col",
        (F.col("_r0") + F.col("_i")).alias("_r"),
        (F.col("_c0") + F.col("_j")).alias("_c"),
        (share_r * share_c).alias("_w"),
    ).filter("_w > 0")
    src = pixels.select(F.col("raster"), F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    # the planner doesn't see that the grid's rows become pixels, and would broadcast them
    met = asked.join(src.hint("merge"), ["raster", "_r", "_c"])
    return met.groupBy("raster", "row", "col").agg(
        *[
            F.try_divide(
                F.sum(F.col(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))
            ).alias(b)
            for b in bands
        ]
    )


def scaled_grid(meta: DataFrame, factor: float) -> DataFrame:
    """Metadata of the same extent with ``factor`` times as many rows and columns."""
    h = F.floor(F.col("height") * F.lit(factor)).cast("long")
    w = F.floor(F.col("width") * F.lit(factor)).cast("long")
    return meta.select(
        "raster",
        "crs",
        (F.col("a") * F.col("width") / w).alias("a"),
        (F.col("b") * F.col("height") / h).alias("b"),
        "c",
        (F.col("d") * F.col("width") / w).alias("d"),
        (F.col("e") * F.col("height") / h).alias("e"),
        "f",
        w.alias("width"),
        h.alias("height"),
        "nodata",
        "n_bands",
    )


def resample(pixels: DataFrame, meta: DataFrame, factor: float, bands: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    target = scaled_grid(meta, factor)
    return match_grid(pixels, meta, target, bands), target


def rename_and_match(
    pixels: DataFrame, meta: DataFrame, names: dict[str, str], target: DataFrame
) -> DataFrame:
    return match_grid(pixels.withColumnsRenamed(names), meta, target, list(names.values()))


def windows_at(
    points: DataFrame,
    pixels: DataFrame,
    meta: DataFrame,
    rasters: Sequence[str],
    bands: Sequence[str],
    height: int,
    width: int,
    key: str = "hex_code",
) -> DataFrame:
    """``(key, raster, i, j, bands)``: a window of each named raster around each point.

    Positions off the raster or without a pixel are zero, on the side where they are missing.
    """
    names = F.array(*[F.lit(r) for r in rasters])
    asked = points.select(key, "lat", "long", F.explode(names).alias("raster"))
    asked = beside_meta(asked, meta, [*"abcdef"], by=[key])
    spot = geom.pixel_at("long", "lat")
    placed = asked.withColumns({"_row": spot["row"], "_col": spot["col"]}).select(key, "raster", "_row", "_col")
    spots = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    keyed = spots.select(
        key,
        "raster",
        "i",
        "j",
        (F.col("_row") - height // 2 + F.col("i")).cast("long").alias("row"),
        (F.col("_col") - width // 2 + F.col("j")).cast("long").alias("col"),
    )
    met = keyed.join(pixels.select("raster", "row", "col", *bands), ["raster", "row", "col"], "left")
    return met.select(key, "raster", "i", "j", *[F.coalesce(F.col(b), F.lit(0.0)).alias(b) for b in bands])


def stack_windows(windows: DataFrame, bands: Sequence[str], key: str = "hex_code") -> DataFrame:
    """One band-major ``pixels`` array per key; its length is fixed by the window and band count."""
    items = F.array(
        *[
            F.struct(
                F.col("raster"), F.lit(n).alias("b"), F.col("i"), F.col("j"), F.col(b).cast("double").alias("v")
            )
            for n, b in enumerate(bands)
        ]
    )
    long = windows.select(key, F.explode(items).alias("p"))
    return long.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("pixels")
    )


def slope_degrees(pixels: DataFrame, meta: DataFrame, band: str) -> DataFrame:
    """Terrain slope from the four side neighbours; null where one is missing.

    Every pixel sends its height to its neighbours and the five values meet in one aggregate;
    contiguous pixels are combined before the shuffle.
    """
    sides = {"n": (1, 0), "s": (-1, 0), "w": (0, 1), "e": (0, -1), "o": (0, 0)}
    sent = pixels.filter(F.col(band).isNotNull()).select(
        "raster",
        F.inline(
            F.array(
                *[
                    F.struct(
                        (F.col("row") + dr).alias("row"),
                        (F.col("col") + dc).alias("col"),
                        F.lit(s).alias("_s"),
                        F.col(band).alias("_v"),
                    )
                    for s, (dr, dc) in sides.items()
                ]
            )
        ),
    )
    met = sent.groupBy("raster", "row", "col").agg(
        *[F.max(F.when(F.col("_s") == s, F.col("_v"))).alias(f"_{s}") for s in sides]
    )
    sized = beside_meta(met.filter("_o IS NOT NULL"), meta, ["a", "e"])
    dx = (F.col("_e") - F.col("_w")) / (F.lit(2.0) * F.abs("a"))
    dy = (F.col("_n") - F.col("_s")) / (F.lit(2.0) * F.abs("e"))
    return sized.select("raster", "row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def scale_population(df: DataFrame, column: str, name: str = "population") -> DataFrame:
    """Mean of 100 m pixels to a count per cell: 25 pixels per 500 m block, 20.6 blocks per cell."""
    return df.withColumn(name, F.col(column) * F.lit(25) * F.lit(20.6))
