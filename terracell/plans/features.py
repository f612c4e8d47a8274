"""Feature tables per cell and their assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import geom, grid
from terracell.operators import aggregates as agg
from terracell.operators import columns as cols
from terracell.operators import spatial
from terracell.schema import RADIOS, ZERO_FILL
from terracell.session import spread


def country_shape(boundaries: DataFrame, country: str, name: str = "NAME", level: int | None = None) -> DataFrame:
    """Boundary rows of one name, at one administrative level if the table has several."""
    out = boundaries.filter(F.col(name) == country)
    return out if level is None else out.filter(F.col("level") == level)


def base_cells(
    boundaries: DataFrame, country: str, res: int, name: str = "NAME", key: str = "zone_id", margin: int = 2
) -> DataFrame:
    """Cells of a country and a margin of two steps around them."""
    shape = country_shape(boundaries, country, name)
    return spatial.with_margin(spatial.cover_cells(shape, key, res).select("hex_code"), margin)


def commuting_zones(zones: DataFrame, country: str, res: int, key: str = "zone_id") -> DataFrame:
    """``(hex_code, *_commuting)``; attributes ride along by the zone key, not by polygon text.

    Overlapping zones give a cell one row per zone, as in the source; see ``one_zone_per_cell``.
    """
    mine = zones.filter(F.col("country") == country)
    cells = spatial.cover_cells(mine, key, res)
    return cols.add_suffix(cells.join(mine, key), "_commuting")


def one_zone_per_cell(zone_cells: DataFrame, order: Sequence[Column]) -> DataFrame:
    return agg.keep_one(zone_cells, ["hex_code"], order)


def conflict_counts(events: DataFrame, country: str, res: int) -> DataFrame:
    keyed = events.filter(F.col("country") == country).select(
        grid.cell_of("latitude", "longitude", res).alias("hex_code"), F.lit(1).alias("one")
    )
    return agg.aggregate_hexagon(keyed, "one", "n_conflicts", "count")


def road_density(cells: DataFrame, roads: DataFrame, res: int) -> DataFrame:
    """Road km per km2 for every cell, zero where there is none."""
    keyed = roads.select(grid.cell_of("lat", "lon", res).alias("hex_code"), "length")
    return agg.left_zero(cells, agg.density_per_cell(keyed, "length", res))


def speed_by_cell(tiles: DataFrame, shape: DataFrame, key: str, res: int, size: float = 1.0) -> DataFrame:
    """Mean download and upload of tiles meeting the shape, by the cell of the tile centroid.

    Corners read from the text give the cheap prefilter; only its survivors meet the outline.
    """
    limits = (
        shape.withColumn("_b", geom.bounds(geom.parse_wkt("geometry")))
        .agg(
            F.min("_b.minx").alias("minx"),
            F.min("_b.miny").alias("miny"),
            F.max("_b.maxx").alias("maxx"),
            F.max("_b.maxy").alias("maxy"),
        )
    )

    def limit(c: str) -> Column:
        return limits.select(c).scalar()

    corner = geom.wkt_corner("geometry")
    near = tiles.withColumn("_c", corner).filter(
        F.col("_c.min_x").between(limit("minx") - 0.1, limit("maxx") + 0.1)
        & F.col("_c.max_y").between(limit("miny") - 0.1, limit("maxy") + 0.1)
    )
    # equal tiles are one row with their number, so a tile can be told from its meetings
    equal = near.groupBy("avg_d_kbps", "avg_u_kbps", "geometry").agg(F.count(F.lit(1)).alias("_times"))
    parsed = equal.withColumn("_g", geom.parse_wkt("geometry"))
    boxed = parsed.select(
        "avg_d_kbps",
        "avg_u_kbps",
        "_times",
        F.xxhash64("geometry").alias("_tile"),
        geom.centroid("_g").alias("_m"),
        geom.bounds("_g").alias("_b"),
    ).select("avg_d_kbps", "avg_u_kbps", "_times", "_tile", "_m", "_b.*")
    # a tile on an inner border meets several rows of the shape and counts once
    met = spatial.boxes_meeting_areas(boxed, shape.select(key, "geometry"), key, size=size)
    once = met.dropDuplicates(["avg_d_kbps", "avg_u_kbps", "_tile"])

    def mean(c: str) -> Column:
        known = F.when(F.col(c).isNotNull(), F.col("_times"))
        return (F.sum(F.col(c) * F.col("_times")) / F.sum(known)).alias(c)

    return (
        once.withColumn("hex_code", grid.cell_of("_m.y", "_m.x", res))
        .groupBy("hex_code")
        .agg(mean("avg_d_kbps"), mean("avg_u_kbps"))
    )


def towers_by_cell(towers: DataFrame, res: int, radios: Sequence[str] = tuple(RADIOS)) -> DataFrame:
    keyed = towers.select(grid.cell_of("lat", "long", res).alias("hex_code"), "radio", "avg_signal")
    return agg.category_counts(keyed, "radio", radios, {"avg_signal": F.avg("avg_signal")})


def cover_polygons(cells: DataFrame, res: int) -> DataFrame:
    """Coarse cells and their neighbours with their outline as "lat lon ..." text."""
    near = cells.select(F.explode(grid.disk("hex_code", 1)).alias("hex_code")).distinct()
    return near.select("hex_code", geom.ring_text(grid.cell_boundary("hex_code", res)).alias("coords"))


def areal_interpolation(
    cells: DataFrame, tiles: DataFrame, res: int, value: str, error: str | None = None, size: float = 0.5
) -> DataFrame:
    """Tile values onto cells: plain means over touching tiles and the area-weighted sum.

    Cells and tiles meet on lattice bins and a pair counts in one bin only; shares are planar in
    degrees. Both are spread over the tasks, as the planner may broadcast either, and what only depends on the cell is
    computed before they meet.
    """
    ring = grid.cell_boundary("hex_code", res)
    hexes = cells.select("hex_code", F.array(F.array(ring)).alias("_h")).withColumns(
        {"_b": geom.bounds("_h"), "_e": geom.edges_of("_h"), "_size": geom.planar_area("_h")}
    )

    def bins(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")))

    left = hexes.withColumn("bx", bins(F.col("_b.minx"), F.col("_b.maxx"))).withColumn(
        "by", bins(F.col("_b.miny"), F.col("_b.maxy"))
    )
    right = tiles.withColumn("bx", bins(F.col("minx"), F.col("maxx"))).withColumn(
        "by", bins(F.col("miny"), F.col("maxy"))
    )
    here = (
        (F.floor(F.greatest("_b.minx", "minx") / size) == F.col("bx"))
        & (F.floor(F.greatest("_b.miny", "miny") / size) == F.col("by"))
        & (F.col("_b.minx") <= F.col("maxx"))
        & (F.col("_b.maxx") >= F.col("minx"))
        & (F.col("_b.miny") <= F.col("maxy"))
        & (F.col("_b.maxy") >= F.col("miny"))
    )
    touching = geom.box_meets_edges("minx", "miny", "maxx", "maxy", "_e")
    met = spread(left).join(spread(right), ["bx", "by"]).filter(here & touching)
    cut = geom.planar_area(geom.clip_to_box("_h", "minx", "miny", "maxx", "maxy"))
    share = met.withColumn("_share", F.coalesce(cut, F.lit(0.0)) / F.col("_size"))
    out = [F.avg(value).alias(value), F.sum(F.col("_share") * F.col(value)).alias(f"weighted_{value}")]
    if error:
        out.append(F.avg(error).alias(error))
    return share.groupBy("hex_code").agg(*out)


def left_join_all(base: DataFrame, parts: Sequence[DataFrame], key: str = "hex_code") -> DataFrame:
    """Left joins on one key in the given order; one partitioning of the base serves them all."""
    out = cols.require(base, [key])
    for part in parts:
        out = out.join(cols.require(part, [key]), key, "left")
    return out


def outer_join_all(parts: Sequence[DataFrame], key: str = "hex_code") -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "outer")
    return out


def append_features(
    cells: DataFrame,
    commuting: DataFrame | None = None,
    conflicts: DataFrame | None = None,
    roads: DataFrame | None = None,
    speed: DataFrame | None = None,
    towers: DataFrame | None = None,
    images: Sequence[DataFrame] = (),
    encodings: DataFrame | None = None,
    fill_zero: Sequence[str] = tuple(ZERO_FILL),
) -> DataFrame:
    """All feature tables left-joined to the base cells; counts absent mean zero."""
    parts = [p for p in (commuting, conflicts, roads, speed, towers) if p is not None]
    if images:
        parts.append(outer_join_all(list(images)))
    if encodings is not None:
        parts.append(encodings)
    return cols.zero_fill(left_join_all(cells, parts), fill_zero)


def audience_request(cells: DataFrame, radius_km: Column | float, goal: str = "REACH") -> DataFrame:
    """The nested request document of each cell as JSON text."""
    radius = radius_km if isinstance(radius_km, Column) else F.lit(radius_km)
    place = F.struct(
        F.col("lat").alias("latitude"),
        F.col("long").alias("longitude"),
        radius.alias("radius"),
        F.lit("kilometer").alias("distance_unit"),
    )
    spec = F.struct(
        F.struct(F.struct(F.array(place).alias("custom_locations")).alias("geo_locations")).alias("targeting_spec"),
        F.lit(goal).alias("optimization_goal"),
    )
    return cells.withColumn("request", F.to_json(spec))
