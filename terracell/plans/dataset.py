"""The model-ready dataset of a country: targets joined onto every cell's features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from terracell.operators import raster as ras
from terracell.plans import features as feat
from terracell.plans.target import create_target
from terracell.schema import DatasetConfig
from terracell.sources import sinks


@dataclass
class RasterInput:
    pixels: DataFrame
    meta: DataFrame
    bands: Sequence[str]
    null_policy: str = "any"


@dataclass
class Inputs:
    """Source tables; any but the survey and the boundary may be absent."""

    survey: DataFrame
    boundaries: DataFrame
    boundary_name: str = "NAME"
    boundary_key: str = "zone_id"
    zones: DataFrame | None = None
    conflicts: DataFrame | None = None
    roads: DataFrame | None = None
    speed: DataFrame | None = None
    towers: DataFrame | None = None
    rasters: Sequence[RasterInput] = ()
    encodings: DataFrame | None = None
    audience: DataFrame | None = None


def build_features(inputs: Inputs, config: DatasetConfig) -> DataFrame:
    """Every cell of the country and its margin with all features. One lazy plan: one shuffle per
    source, then joins on the one cell key."""
    country, res = config.country, config.res
    cells = feat.base_cells(inputs.boundaries, country, res, inputs.boundary_name, inputs.boundary_key)
    shape = feat.country_shape(inputs.boundaries, country, inputs.boundary_name)
    zones = None
    if inputs.zones is not None:
        zones = feat.commuting_zones(inputs.zones, country, res)
        zones = zones.drop(*[c for c in ("zone_id_commuting", "country_commuting", "geometry_commuting") if c in zones.columns])
    images = [ras.cells_from_raster(r.pixels, r.meta, r.bands, res, null_policy=r.null_policy) for r in inputs.rasters]
    out = feat.append_features(
        cells,
        commuting=zones,
        conflicts=None if inputs.conflicts is None else feat.conflict_counts(inputs.conflicts, country, res),
        roads=None if inputs.roads is None else feat.road_density(cells, inputs.roads, res),
        speed=None if inputs.speed is None else feat.speed_by_cell(inputs.speed, shape, inputs.boundary_key, res),
        towers=None if inputs.towers is None else feat.towers_by_cell(inputs.towers, res),
        images=images,
        encodings=inputs.encodings,
        fill_zero=config.fill_zero,
    )
    return out if inputs.audience is None else out.join(inputs.audience, "hex_code", "left")


def create_dataset(inputs: Inputs, config: DatasetConfig) -> tuple[DataFrame, DataFrame]:
    """Features with plain targets for every cell, and the expanded targets."""
    args = (inputs.survey, config.country_code, config.res, config.lat, config.long, config.threshold)
    plain = create_target(*args)
    expanded = create_target(*args, copy_to_nbrs=True)
    return build_features(inputs, config).join(plain, "hex_code", "left"), expanded


def write_country(inputs: Inputs, config: DatasetConfig, root: str) -> None:
    complete, expanded = create_dataset(inputs, config)
    sinks.write_dataset(complete, f"{root}/hexes", config.country, config.res, config.threshold)
    sinks.write_dataset(expanded, f"{root}/expanded", config.country, config.res, config.threshold)
