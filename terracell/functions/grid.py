"""Equal-area hexagonal cell grid as pure column expressions.

A cell id is one ``bigint``: ``res * 2^56 + (q + 2^27) * 2^28 + (r + 2^27)``, with ``(q, r)`` the
axial coordinates of a pointy-top hexagon in a Lambert cylindrical equal-area plane. Ids are
linear in ``q`` and ``r``, so a neighbour is the id plus a constant: disks and rings are arrays of
``cell + offset`` and never leave whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.util import as_col

# Mean hexagon area in km2 by resolution 0..15.
CELL_AREA_KM2 = {
    0: 4250546.8477000,
    1: 607220.9782429,
    2: 86745.8540347,
    3: 12392.2648621,
    4: 1770.3235517,
    5: 252.9033645,
    6: 36.1290521,
    7: 5.1612932,
    8: 0.7373276,
    9: 0.1053325,
    10: 0.0150475,
    11: 0.0021496,
    12: 0.0003071,
    13: 0.0000439,
    14: 0.0000063,
    15: 0.0000009,
}

EARTH_KM = 6371.0072  # authalic radius
SQRT3 = math.sqrt(3.0)

_BIAS = 1 << 27
_Q_UNIT = 1 << 28
_RES_UNIT = 1 << 56
_MASK = (1 << 28) - 1


def cell_radius_km(res: int) -> float:
    """Circumradius (= side) of a hexagon of the given resolution."""
    return math.sqrt(CELL_AREA_KM2[res] * 2 / (3 * SQRT3))


def cell_area_km2(res: Column | str) -> Column:
    """Area by a resolution column; null for an unknown resolution."""
    table = F.array(*[F.lit(a) for a in CELL_AREA_KM2.values()])
    res = as_col(res)
    return F.when(res.between(0, 15), F.get(table, res.cast("int")))


def project_x(long: Column | str) -> Column:
    return F.lit(EARTH_KM) * F.radians(as_col(long))


def project_y(lat: Column | str) -> Column:
    return F.lit(EARTH_KM) * F.sin(F.radians(as_col(lat)))


def _side(cell: Column, res: int | None) -> Column:
    if res is not None:
        return F.lit(cell_radius_km(res))
    return F.get(
        F.array(*[F.lit(cell_radius_km(i)) for i in CELL_AREA_KM2]), cell_res(cell).cast("int")
    )


def cell_id(res: int, q: Column, r: Column) -> Column:
    return (
        F.lit(res * _RES_UNIT)
        + (q.cast("long") + F.lit(_BIAS)) * F.lit(_Q_UNIT)
        + (r.cast("long") + F.lit(_BIAS))
    )


def cell_of(lat: Column | str, long: Column | str, res: int) -> Column:
    """Cell holding a point; null when a coordinate is null."""
    unit = F.lit(cell_radius_km(res) * SQRT3)
    x, y = project_x(long) / unit, project_y(lat) / unit
    # Floors of three slanted coordinates name the small triangle holding the point; thirds of
    # their sums are the row r and the slanted column p = q + r of the nearest centre.
    up = F.lit(SQRT3) * y
    band = F.floor(x + up + F.lit(1.0))
    r = F.floor((band + F.floor(up - x + F.lit(1.0))) / F.lit(3.0))
    p = F.floor((F.floor(F.lit(2.0) * x + F.lit(1.0)) + band) / F.lit(3.0))
    origin = res * _RES_UNIT + _BIAS * _Q_UNIT + _BIAS
    return F.lit(origin) + p * F.lit(_Q_UNIT) + r * F.lit(1 - _Q_UNIT)


def cell_res(cell: Column | str) -> Column:
    return F.shiftrightunsigned(as_col(cell), 56)


def cell_q(cell: Column | str) -> Column:
    return F.shiftrightunsigned(as_col(cell), 28).bitwiseAND(F.lit(_MASK)) - F.lit(_BIAS)


def cell_r(cell: Column | str) -> Column:
    return as_col(cell).bitwiseAND(F.lit(_MASK)) - F.lit(_BIAS)


def cell_lat(cell: Column | str, res: int | None = None) -> Column:
    cell = as_col(cell)
    y = F.lit(1.5) * _side(cell, res) * cell_r(cell)
    return F.degrees(F.asin(y / F.lit(EARTH_KM)))


def cell_long(cell: Column | str, res: int | None = None) -> Column:
    cell = as_col(cell)
    x = _side(cell, res) * F.lit(SQRT3) * (cell_q(cell) + cell_r(cell) / F.lit(2.0))
    return F.degrees(x / F.lit(EARTH_KM))


def cell_centroid(cell: Column | str, res: int | None = None) -> Column:
    return F.struct(cell_lat(cell, res).alias("lat"), cell_long(cell, res).alias("long"))


def cell_boundary(cell: Column | str, res: int | None = None) -> Column:
    """Closed ring of the six vertices, ``array<struct<x,y>>`` in degrees."""
    cell = as_col(cell)
    side = _side(cell, res)
    cx = side * F.lit(SQRT3) * (cell_q(cell) + cell_r(cell) / F.lit(2.0))
    cy = F.lit(1.5) * side * cell_r(cell)

    def vertex(i: int) -> Column:
        angle = math.radians(30 + 60 * (i % 6))
        x = cx + side * F.lit(math.cos(angle))
        y = cy + side * F.lit(math.sin(angle))
        return F.struct(
            F.degrees(x / F.lit(EARTH_KM)).alias("x"),
            F.degrees(F.asin(y / F.lit(EARTH_KM))).alias("y"),
        )

    return F.array(*[vertex(i) for i in range(7)])


def axial_offsets(k: int) -> list[tuple[int, int]]:
    """Axial offsets at grid distance at most k."""
    return [
        (dq, dr)
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    ]


def axial_distance(dq: int, dr: int) -> int:
    return (abs(dq) + abs(dr) + abs(dq + dr)) // 2


def _shifted(cell: Column, offsets: list[tuple[int, int]]) -> Column:
    return F.array(*[cell + F.lit(dq * _Q_UNIT + dr) for dq, dr in offsets])


def disk(cell: Column | str, k: int) -> Column:
    """All cells within k steps, the cell itself included: ``1 + 3k(k+1)`` ids."""
    return _shifted(as_col(cell), axial_offsets(k))


def ring(cell: Column | str, distance: int) -> Column:
    """Cells at exactly the given distance."""
    offsets = [o for o in axial_offsets(distance) if axial_distance(*o) == distance]
    return _shifted(as_col(cell), offsets)


def ring_distances(cell: Column | str, k: int) -> Column:
    """``array<struct<hex_code, distance>>`` of the disk without its centre."""
    cell = as_col(cell)
    return F.array(
        *[
            F.struct(
                (cell + F.lit(dq * _Q_UNIT + dr)).alias("hex_code"),
                F.lit(axial_distance(dq, dr)).cast("long").alias("distance"),
            )
            for dq, dr in axial_offsets(k)
            if (dq, dr) != (0, 0)
        ]
    )


def grid_distance(a: Column | str, b: Column | str) -> Column:
    """Steps between two cells of one resolution; null across resolutions."""
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    steps = F.shiftright(F.abs(dq) + F.abs(dr) + F.abs(dq + dr), 1)
    return F.when(cell_res(a) == cell_res(b), steps)


def displaced_disk(cell: Column | str, location: Column | str) -> Column:
    """Disk over which a survey answer may lie: 1 step for urban (1), else 2 steps."""
    return F.when(as_col(location) == 1, disk(cell, 1)).otherwise(disk(cell, 2))


def cell_text(cell: Column | str) -> Column:
    return F.lower(F.hex(as_col(cell)))


def cell_from_text(text: Column | str) -> Column:
    return F.conv(as_col(text), 16, 10).cast("long")


def coarser(cell: Column | str, res: int) -> Column:
    """Cell of another resolution holding this cell's centroid."""
    return cell_of(cell_lat(cell), cell_long(cell), res)
