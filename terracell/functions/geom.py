"""Planar and spherical geometry as column expressions.

At rest a geometry is WKT text. In flight it is ``array<array<array<struct<x,y>>>>``: parts, then
rings (outer first, holes after), then closed vertex lists. No Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.grid import project_x, project_y
from terracell.functions.util import as_col, let

HAVERSINE_KM = 6371.0
WEB_MERCATOR_M = 6378137.0
_PART = r"\((\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*)\)"
_RING = r"\(([^()]+)\)"


def point(long: Column | str, lat: Column | str) -> Column:
    return F.struct(as_col(long).alias("x"), as_col(lat).alias("y"))


def point_lat(geometry: Column | str) -> Column:
    return as_col(geometry)["y"]


def point_long(geometry: Column | str) -> Column:
    return as_col(geometry)["x"]


def _vertex(text: Column) -> Column:
    return let(
        F.split(F.trim(text), r"\s+"),
        lambda xy: F.struct(
            F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y")
        ),
    )


def _ring_of(text: Column) -> Column:
    return F.transform(F.split(text, ","), _vertex)


def parse_wkt(wkt: Column | str) -> Column:
    """POLYGON or MULTIPOLYGON text to parts; any other shape raises."""
    wkt = as_col(wkt)
    kind = F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))
    parts = F.transform(
        F.regexp_extract_all(wkt, F.lit(_PART), F.lit(1)),
        lambda part: F.transform(F.regexp_extract_all(part, F.lit(_RING), F.lit(1)), _ring_of),
    )
    refuse = F.raise_error(F.concat(F.lit("not a polygon: "), kind))
    return F.when(wkt.isNull() | kind.isin("POLYGON", "MULTIPOLYGON"), parts).otherwise(
        refuse.cast("array<array<array<struct<x:double,y:double>>>>")
    )


def parse_geojson(kind: Column | str, coordinates: Column | str) -> Column:
    """Parts of a Polygon or MultiPolygon whose coordinates are JSON text; null for other kinds and broken text.

    Only the first two numbers of a position count.
    """
    kind, text = as_col(kind), as_col(coordinates)
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    nested = F.when((kind == "Polygon") & one.isNotNull(), F.array(one)).when(kind == "MultiPolygon", many)
    return F.transform(
        nested,
        lambda part: F.transform(
            part,
            lambda ring: F.transform(
                ring, lambda at: F.struct(F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"))
            ),
        ),
    )


def geojson_geometry(parts: Column | str) -> Column:
    """A geometry object as JSON text: Polygon for a single part, else MultiPolygon."""
    nested = F.transform(
        as_col(parts),
        lambda part: F.transform(part, lambda ring: F.transform(ring, lambda at: F.array(at["x"], at["y"]))),
    )
    single = F.size(nested) == 1
    kind = F.when(single, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))
    text = F.when(single, F.to_json(F.get(nested, F.lit(0)))).otherwise(F.to_json(nested))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}"))


def rings_of(parts: Column | str) -> Column:
    return F.flatten(as_col(parts))


def ring_edges(ring: Column) -> Column:
    """``array<struct<x1,y1,x2,y2>>`` of a closed ring."""

    def pairs(ring: Column) -> Column:
        starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - F.lit(1), F.lit(0)))
        ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - F.lit(1), F.lit(0)))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return let(ring, pairs)


def edges_of(parts: Column | str) -> Column:
    """All edges of all rings; even-odd tests over them honour holes."""
    return F.flatten(F.transform(rings_of(parts), ring_edges))


def bounds(parts: Column | str) -> Column:

    def box(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.struct(
            F.array_min(xs).alias("minx"),
            F.array_min(ys).alias("miny"),
            F.array_max(xs).alias("maxx"),
            F.array_max(ys).alias("maxy"),
        )

    return let(F.flatten(rings_of(parts)), box)


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    spans = (edge["y1"] > y) != (edge["y2"] > y)
    slope = F.try_divide(edge["x2"] - edge["x1"], edge["y2"] - edge["y1"])
    return spans & (x < edge["x1"] + (y - edge["y1"]) * slope)


def inside_edges(edges: Column | str, x: Column | str, y: Column | str) -> Column:
    """Even-odd rule over prepared edges."""
    x, y = as_col(x), as_col(y)
    return F.size(F.filter(as_col(edges), lambda e: _crosses(e, x, y))) % 2 == 1


def contains_point(parts: Column | str, x: Column | str, y: Column | str) -> Column:
    return inside_edges(edges_of(parts), x, y)


def _ring_moments(ring: Column) -> Column:
    """Signed doubled area and first moments of a ring."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "mx", "my")])

    def step(acc: Column, e: Column) -> Column:
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"),
            (acc["my"] + (e["y1"] + e["y2"]) * cross).alias("my"),
        )

    return F.aggregate(ring_edges(ring), zero, step)


def _oriented_moments(parts: Column) -> Column:
    """Moments per ring with outer rings counted up and holes counted down."""

    def of_part(part: Column) -> Column:
        def of_ring(ring: Column, i: Column) -> Column:
            def signed(m: Column) -> Column:
                sign = F.when(i == 0, F.signum(m["a"])).otherwise(-F.signum(m["a"]))
                return F.struct(
                    (m["a"] * sign).alias("a"),
                    (m["mx"] * sign).alias("mx"),
                    (m["my"] * sign).alias("my"),
                )

            return let(_ring_moments(ring), signed)

        return F.transform(part, of_ring)

    return F.flatten(F.transform(parts, of_part))


def _total(moments: Column, name: str) -> Column:
    return F.aggregate(moments, F.lit(0.0), lambda acc, m: acc + m[name])


def planar_area(parts: Column | str) -> Column:
    """Unsigned area in the units of the coordinates, holes removed."""
    return _total(_oriented_moments(as_col(parts)), "a") / F.lit(2.0)


def centroid(parts: Column | str) -> Column:
    return let(
        _oriented_moments(as_col(parts)),
        lambda m: F.struct(
            F.try_divide(_total(m, "mx"), F.lit(3.0) * _total(m, "a")).alias("x"),
            F.try_divide(_total(m, "my"), F.lit(3.0) * _total(m, "a")).alias("y"),
        ),
    )


def map_vertices(parts: Column | str, fn) -> Column:
    return F.transform(
        as_col(parts), lambda part: F.transform(part, lambda ring: F.transform(ring, fn))
    )


def area_km2(parts: Column | str) -> Column:
    """Area on the authalic sphere: shoelace in the equal-area plane."""
    plane = map_vertices(
        parts,
        lambda p: F.struct(project_x(p["x"]).alias("x"), project_y(p["y"]).alias("y")),
    )
    return planar_area(plane)


def _side_of(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _segments_meet(a: Column, b: Column) -> Column:
    d1 = _side_of(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d2 = _side_of(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    d3 = _side_of(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d4 = _side_of(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    apart = (
        (F.greatest(a["x1"], a["x2"]) < F.least(b["x1"], b["x2"]))
        | (F.greatest(b["x1"], b["x2"]) < F.least(a["x1"], a["x2"]))
        | (F.greatest(a["y1"], a["y2"]) < F.least(b["y1"], b["y2"]))
        | (F.greatest(b["y1"], b["y2"]) < F.least(a["y1"], a["y2"]))
    )
    return ~apart & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def edges_intersect(edges_a: Column | str, edges_b: Column | str) -> Column:
    """True when two areas given by their edges share at least one point."""

    def meet(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
        return (
            F.exists(a, lambda ea: F.exists(b, lambda eb: _segments_meet(ea, eb)))
            | inside_edges(b, first_a["x1"], first_a["y1"])
            | inside_edges(a, first_b["x1"], first_b["y1"])
        )

    return let(F.struct(as_col(edges_a).alias("a"), as_col(edges_b).alias("b")), meet)


def intersects(parts_a: Column | str, parts_b: Column | str) -> Column:
    return edges_intersect(edges_of(parts_a), edges_of(parts_b))


def box_meets_edges(minx, miny, maxx, maxy, edges: Column | str) -> Column:
    """True when a closed box shares a point with the area of the given edges.

    Either an edge touches the box, by overlap of ranges and the box's corners not all lying on
    one side of it, or the box's top left corner is inside. Only edges whose y range meets the
    box's are needed.
    """
    minx, miny, maxx, maxy = (as_col(v) for v in (minx, miny, maxx, maxy))

    def touches(e: Column) -> Column:
        near = (
            (F.greatest(e["x1"], e["x2"]) >= minx)
            & (F.least(e["x1"], e["x2"]) <= maxx)
            & (F.greatest(e["y1"], e["y2"]) >= miny)
            & (F.least(e["y1"], e["y2"]) <= maxy)
        )
        sides = [
            _side_of(e["x1"], e["y1"], e["x2"], e["y2"], cx, cy) for cx in (minx, maxx) for cy in (miny, maxy)
        ]
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(as_col(edges), touches) | inside_edges(edges, minx, maxy)


def _clip_half_plane(ring: Column, axis: str, bound: Column, keep_below: bool) -> Column:
    """Part of a closed ring on one side of an axis-parallel line, closed again."""
    other = "y" if axis == "x" else "x"

    def kept(v: Column) -> Column:
        return v <= bound if keep_below else v >= bound

    def on_line(e: Column) -> Column:
        a, b = e[axis + "1"], e[axis + "2"]
        t = F.try_divide(bound - a, b - a)
        cut = e[other + "1"] + t * (e[other + "2"] - e[other + "1"])
        xy = {axis: bound, other: cut}
        return F.struct(xy["x"].alias("x"), xy["y"].alias("y"))

    def emit(e: Column) -> Column:
        end = F.struct(e["x2"].alias("x"), e["y2"].alias("y"))
        a_in, b_in = kept(e[axis + "1"]), kept(e[axis + "2"])
        return (
            F.when(a_in & b_in, F.array(end))
            .when(a_in, F.array(on_line(e)))
            .when(b_in, F.array(on_line(e), end))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    return let(
        F.flatten(F.transform(ring_edges(ring), emit)),
        lambda out: F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out),
    )


def clip_to_box(parts: Column | str, minx, miny, maxx, maxy) -> Column:
    """Polygon cut to an axis-parallel box, ring by ring."""

    def clip_ring(ring: Column) -> Column:
        ring = _clip_half_plane(ring, "x", as_col(minx), keep_below=False)
        ring = _clip_half_plane(ring, "x", as_col(maxx), keep_below=True)
        ring = _clip_half_plane(ring, "y", as_col(miny), keep_below=False)
        return _clip_half_plane(ring, "y", as_col(maxy), keep_below=True)

    return F.transform(as_col(parts), lambda part: F.transform(part, clip_ring))


def haversine_km(lat1, long1, lat2, long2) -> Column:
    p1, p2 = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    dp = p2 - p1
    dl = F.radians(as_col(long2)) - F.radians(as_col(long1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.lit(2 * HAVERSINE_KM) * F.asin(F.sqrt(a))


def transform_xy(x: Column | str, y: Column | str, source: str, target: str) -> Column:
    """Point between geographic, web-mercator and equal-area coordinates (x, y order)."""
    lon, lat = _to_geographic(as_col(x), as_col(y), source)
    px, py = _from_geographic(lon, lat, target)
    return F.struct(px.alias("x"), py.alias("y"))


def _to_geographic(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return x, y
    if crs == "EPSG:3857":
        lat = F.lit(2.0) * F.atan(F.exp(y / F.lit(WEB_MERCATOR_M))) - F.lit(math.pi / 2)
        return F.degrees(x / F.lit(WEB_MERCATOR_M)), F.degrees(lat)
    if crs == "equal-area-km":
        from terracell.functions.grid import EARTH_KM

        return F.degrees(x / F.lit(EARTH_KM)), F.degrees(F.asin(y / F.lit(EARTH_KM)))
    raise ValueError(f"unsupported coordinate system: {crs}")


def _from_geographic(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    if crs == "EPSG:4326":
        return lon, lat
    if crs == "EPSG:3857":
        m = F.lit(WEB_MERCATOR_M)
        return m * F.radians(lon), m * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0)))
    if crs == "equal-area-km":
        return project_x(lon), project_y(lat)
    raise ValueError(f"unsupported coordinate system: {crs}")


def pixel_centre(meta: Column | None, row: Column | str, col: Column | str) -> Column:
    """Centre of a pixel through the affine columns a..f (of a struct, or of the row itself)."""
    p = (lambda n: F.col(n)) if meta is None else (lambda n: meta[n])
    r, c = as_col(row) + F.lit(0.5), as_col(col) + F.lit(0.5)
    return F.struct(
        (p("a") * c + p("b") * r + p("c")).alias("x"),
        (p("d") * c + p("e") * r + p("f")).alias("y"),
    )


def pixel_at(x: Column | str, y: Column | str) -> Column:
    """Row and column holding a coordinate, by the inverse affine of columns a..f."""
    fr = pixel_position(x, y)
    return F.struct(F.floor(fr["row"]).alias("row"), F.floor(fr["col"]).alias("col"))


def pixel_position(x: Column | str, y: Column | str) -> Column:
    """Fractional (row, col) of a coordinate; pixel (0, 0) spans [0, 1)."""
    dx, dy = as_col(x) - F.col("c"), as_col(y) - F.col("f")
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    return F.struct(
        ((F.col("a") * dy - F.col("d") * dx) / det).alias("row"),
        ((F.col("e") * dx - F.col("b") * dy) / det).alias("col"),
    )


def wkt_corner(wkt: Column | str) -> Column:
    """First x and last y of a one-ring polygon, read from the text."""
    numbers = F.split(F.regexp_replace(as_col(wkt), r"POLYGON\s*\(+|\)", ""), r",?\s+")
    return F.struct(
        F.get(numbers, F.lit(0)).cast("double").alias("min_x"),
        F.element_at(numbers, -1).cast("double").alias("max_y"),
    )


def ring_text(ring: Column | str) -> Column:
    """"lat lon lat lon ..." of a ring without its closing vertex."""
    ring = as_col(ring)
    return F.array_join(
        F.transform(
            F.slice(ring, F.lit(1), F.size(ring) - F.lit(1)),
            lambda p: F.format_string("%.6f %.6f", p["y"], p["x"]),
        ),
        " ",
    )


def box_wkt(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    def pair(x: Column, y: Column) -> Column:
        return F.concat_ws(" ", x.cast("string"), y.cast("string"))

    corners = [pair(minx, miny), pair(maxx, miny), pair(maxx, maxy), pair(minx, maxy), pair(minx, miny)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))


def box_parts(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corners = [(minx, maxy), (maxx, maxy), (maxx, miny), (minx, miny), (minx, maxy)]
    return F.array(F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])))


def quadkey_box(quadkey: Column | str) -> Column:
    """Bounds of the web-mercator tile named by a quadkey (two bits per digit)."""
    quadkey = as_col(quadkey)
    n = F.pow(F.lit(2.0), F.length(quadkey))
    tx = F.conv(F.translate(quadkey, "0123", "0101"), 2, 10).cast("double")
    ty = F.conv(F.translate(quadkey, "0123", "0011"), 2, 10).cast("double")

    def lat(t: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * t / n))))

    def lon(t: Column) -> Column:
        return t / n * F.lit(360.0) - F.lit(180.0)

    return F.struct(
        lon(tx).alias("minx"),
        lat(ty + 1).alias("miny"),
        lon(tx + 1).alias("maxx"),
        lat(ty).alias("maxy"),
    )


def quadkey_polygon(quadkey: Column | str) -> Column:
    """Tile ring in north-west, north-east, south-east, south-west order, as parts."""
    b = quadkey_box(quadkey)
    return box_parts(b["minx"], b["miny"], b["maxx"], b["maxy"])
