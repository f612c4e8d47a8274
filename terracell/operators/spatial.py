"""Spatial joins and covers as equi-joins on coarse bins.

Areas are cut into bins of a regular degree lattice. A bin no edge touches is wholly inside, so
its points need no test at all; only the bins on an outline carry the edges. Sides are not hinted:
the planner broadcasts an area table whose measured size allows it and otherwise shuffles on the
bin, splitting hot bins by its skew rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import geom, grid
from terracell.functions.util import as_col
from terracell.session import spread as spread_rows


def _bin(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def area_bins(
    areas: DataFrame, key: str, parts: str, size: float, margin: float = 0.0, whole_box: bool = False
) -> DataFrame:
    """``(key, _bx, _by, full, edges, box)``: one row per area and lattice bin it touches.

    ``edges`` of an outline bin are those of its row of bins, widened by the margin: enough to
    decide every horizontal ray starting in the row. Inner bins carry none. ``whole_box`` keeps
    the bins of the bounding box the area does not touch, too.
    """
    lo, hi = F.col("box.minx"), F.col("box.maxx")
    boxed = areas.select(F.col(key), geom.edges_of(parts).alias("_e"), geom.bounds(parts).alias("box"))
    rows = boxed.withColumn(
        "_by", F.explode(F.sequence(_bin(F.col("box.miny"), size), _bin(F.col("box.maxy"), size)))
    )
    y0 = F.col("_by") * F.lit(size)
    banded = rows.withColumn(
        "_e",
        F.filter(
            "_e",
            lambda e: (F.greatest(e["y1"], e["y2"]) >= y0 - F.lit(margin))
            & (F.least(e["y1"], e["y2"]) <= y0 + F.lit(size + margin)),
        ),
    )
    cells = banded.withColumn("_bx", F.explode(F.sequence(_bin(lo, size), _bin(hi, size))))
    x0 = F.col("_bx") * F.lit(size)
    touched = F.exists(
        "_e",
        lambda e: (F.greatest(e["x1"], e["x2"]) >= x0)
        & (F.least(e["x1"], e["x2"]) <= x0 + F.lit(size))
        & (F.greatest(e["y1"], e["y2"]) >= y0)
        & (F.least(e["y1"], e["y2"]) <= y0 + F.lit(size)),
    )
    centre_in = geom.inside_edges("_e", x0 + F.lit(size / 2), y0 + F.lit(size / 2))
    judged = cells.withColumns({"_touched": touched, "_in": centre_in}).withColumn(
        "full", F.col("_in") & ~F.col("_touched")
    )
    if not whole_box:
        judged = judged.filter(F.col("_touched") | F.col("_in"))
    return (
        judged.select(key, "_bx", "_by", "full", F.when(~F.col("full"), F.col("_e")).alias("edges"), "box")
    )


def points_in_areas(
    points: DataFrame,
    areas: DataFrame,
    key: str,
    geometry: str = "geometry",
    x: str = "long",
    y: str = "lat",
    size: float = 1.0,
    how: str = "inner",
) -> DataFrame:
    """Points with the key of each area holding them (``how`` inner, or left_semi to clip)."""
    prepared = areas.select(F.col(key), geom.parse_wkt(geometry).alias("_parts"))
    bins = area_bins(prepared, key, "_parts", size)
    left = points.withColumn("_bx", _bin(F.col(x), size)).withColumn("_by", _bin(F.col(y), size))
    on = (
        (left["_bx"] == bins["_bx"])
        & (left["_by"] == bins["_by"])
        & (bins["full"] | geom.inside_edges(bins["edges"], left[x], left[y]))
    )
    joined = left.join(bins, on, how)
    keep = [left[c] for c in points.columns]
    return joined.select(*keep) if how == "left_semi" else joined.select(*keep, bins[key])


def boxes_meeting_areas(
    boxes: DataFrame,
    areas: DataFrame,
    key: str,
    geometry: str = "geometry",
    box: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy"),
    size: float = 1.0,
    margin: float = 4.0,
) -> DataFrame:
    """Axis-parallel boxes (tiles) with the key of each area they intersect.

    No box may be taller than ``margin`` degrees.

    A pair that meets in several bins is reported in one of them only, the one holding the lower
    corner of the two bounding boxes' overlap, so no distinct is needed. That bin need not touch the
    area, so the areas keep every bin of their bounding box. Boxes and bins are spread over the tasks first: the
    planner may broadcast either side, and the rows of a small file are much work in one task.
    """
    minx, miny, maxx, maxy = (F.col(c) for c in box)
    prepared = areas.select(F.col(key), geom.parse_wkt(geometry).alias("_parts"))
    bins = area_bins(prepared, key, "_parts", size, margin, whole_box=True).withColumnRenamed("box", "_area")
    spread = spread_rows(boxes).withColumn(
        "_bx", F.explode(F.sequence(_bin(minx, size), _bin(maxx, size)))
    ).withColumn("_by", F.explode(F.sequence(_bin(miny, size), _bin(maxy, size))))
    a = F.col("_area")
    overlap = (minx <= a["maxx"]) & (maxx >= a["minx"]) & (miny <= a["maxy"]) & (maxy >= a["miny"])
    here = (F.col("_bx") == _bin(F.greatest(minx, a["minx"]), size)) & (
        F.col("_by") == _bin(F.greatest(miny, a["miny"]), size)
    )
    fits = F.when(maxy - miny <= margin, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a box is taller than {margin} degrees")).cast("boolean")
    )
    meets = fits & (F.col("full") | geom.box_meets_edges(minx, miny, maxx, maxy, "edges"))
    return spread.join(spread_rows(bins), ["_bx", "_by"]).filter(overlap & here & meets).select(*boxes.columns, key)


def cover_cells(areas: DataFrame, key: str, res: int, geometry: str = "geometry") -> DataFrame:
    """``(key, hex_code)``: cells whose centroid lies in the area, each pair once.

    Scan conversion: every edge is cut by the grid rows it crosses, the crossings of one row are
    paired off, and each span becomes its run of cells. Work follows outline length plus cells
    found; no cell of the bounding box is tested and no array is longer than one grid row.
    """
    side = grid.cell_radius_km(res)
    row_km = 1.5 * side
    edges = (
        areas.select(F.col(key), geom.edges_of(geom.parse_wkt(geometry)).alias("_e"))
        .select(key, F.explode("_e").alias("e"))
        .select(key, "e.*")
    )
    low = grid.project_y(F.least("y1", "y2")) / F.lit(row_km)
    high = grid.project_y(F.greatest("y1", "y2")) / F.lit(row_km)
    rows = edges.withColumn(
        "r", F.explode(F.sequence(F.floor(low).cast("long"), F.ceil(high).cast("long")))
    ).withColumn("lat", F.degrees(F.asin(F.col("r") * F.lit(row_km) / F.lit(grid.EARTH_KM))))
    crossing = rows.filter((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))).select(
        key,
        "r",
        (
            F.col("x1")
            + (F.col("lat") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
        ).alias("x"),
    )
    spans = (
        crossing.groupBy(key, "r")
        .agg(F.array_sort(F.collect_list("x")).alias("xs"))
        .select(
            key,
            "r",
            F.explode(F.sequence(F.lit(0), F.size("xs") - F.lit(2), F.lit(2))).alias("i"),
            "xs",
        )
        .select(key, "r", F.get("xs", F.col("i")).alias("x0"), F.get("xs", F.col("i") + 1).alias("x1"))
    )
    step = F.lit(side * grid.SQRT3)
    first = F.ceil(grid.project_x("x0") / step - F.col("r") / F.lit(2.0)).cast("long")
    last = F.ceil(grid.project_x("x1") / step - F.col("r") / F.lit(2.0)).cast("long") - F.lit(1)
    cells = (
        spans.withColumn("q0", first)
        .withColumn("q1", last)
        .filter(F.col("q0") <= F.col("q1"))
        .select(key, "r", F.explode(F.sequence("q0", "q1")).alias("q"))
        .select(key, grid.cell_id(res, F.col("q"), F.col("r")).alias("hex_code"))
    )
    return cells.distinct()


def new_neighbours(cells: DataFrame, k: int) -> DataFrame:
    """Cells within k steps of the set but not in it."""
    near = cells.select(F.explode(grid.disk("hex_code", k)).alias("hex_code")).distinct()
    return near.join(cells.select("hex_code"), "hex_code", "left_anti")


def with_margin(cells: DataFrame, k: int = 2) -> DataFrame:
    """A cell set and its k-step margin: the disks' union already holds both."""
    return cells.select(F.explode(grid.disk("hex_code", k)).alias("hex_code")).distinct()


def neighbour_pairs(cells: DataFrame, k: int, values: list[str]) -> DataFrame:
    """Each cell with the values of the cells within k steps, centre left out."""
    near = cells.select("hex_code", F.explode(grid.ring_distances("hex_code", k)).alias("n")).select(
        "hex_code", F.col("n.hex_code").alias("nbr"), F.col("n.distance").alias("distance")
    )
    other = cells.select(F.col("hex_code").alias("nbr"), *[F.col(v) for v in values])
    return near.join(other, "nbr")


def bounding_box_filter(df: DataFrame, x: str, y: str, box: tuple, margin: float = 0.1) -> DataFrame:
    """Cheap prefilter that reaches the file statistics."""
    minx, miny, maxx, maxy = box
    return df.filter(
        as_col(x).between(minx - margin, maxx + margin) & as_col(y).between(miny - margin, maxy + margin)
    )
