"""Deprivation targets per cell from survey microdata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terracell.functions import grid
from terracell.operators import aggregates as agg
from terracell.operators import columns as cols


def add_centroid(df: DataFrame, res: int, cell: str = "hex_code") -> DataFrame:
    return df.withColumns({"lat": grid.cell_lat(cell, res), "long": grid.cell_long(cell, res)})


def keyed_survey(survey: DataFrame, country_code: str, res: int, lat: str, long: str) -> DataFrame:
    """Rows of one country with flags and cell key."""
    rows = cols.select_country(survey, country_code, lat, long)
    return cols.k_or_more(rows).withColumn("hex_code", grid.cell_of(lat, long, res))


def create_target(
    survey: DataFrame,
    country_code: str,
    res: int,
    lat: str = "latnum",
    long: str = "longnum",
    threshold: int = 30,
    copy_to_nbrs: bool = False,
    check: bool = False,
) -> DataFrame:
    """One row per cell with enough answers.

    Plain: mean of every numeric column, ``survey`` holding the row count. With ``copy_to_nbrs``
    each answer also counts in the cells it may have been displaced from, under expanded names.
    """
    rows = keyed_survey(survey, country_code, res, lat, long)
    if check:
        cols.require_rows(rows, f"no geocoded rows for {country_code}")
    if copy_to_nbrs:
        spread = cols.rename_short(agg.spread_to_neighbours(rows))
        kept = agg.at_least(spread, "sumpoor_count", threshold)
    else:
        kept = agg.at_least(agg.mean_by_cell(rows), "survey", threshold)
    return add_centroid(kept, res)
