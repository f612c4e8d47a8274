"""Reducers over time-stamped pixel tables ``(collection, band, ts, row, col, value)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.schema import IMAGERY_END, IMAGERY_START

PIXEL = ["collection", "band", "row", "col"]


def between_dates(images: DataFrame, start: str | None = IMAGERY_START, end: str | None = IMAGERY_END) -> DataFrame:
    """Half-open date range; an end that is None is open, and undated images need both open."""
    kind = dict(images.dtypes)["ts"]
    if start is not None:
        images = images.filter(F.col("ts") >= F.lit(start).cast(kind))
    return images if end is None else images.filter(F.col("ts") < F.lit(end).cast(kind))


def select_bands(images: DataFrame, bands: Sequence[str]) -> DataFrame:
    return images.filter(F.col("band").isin(list(bands)))


def mean_over_time(images: DataFrame, name: str = "value") -> DataFrame:
    return images.groupBy(*PIXEL).agg(F.avg("value").alias(name))


def stddev_over_time(images: DataFrame, name: str = "value") -> DataFrame:
    """Population standard deviation per pixel."""
    return images.groupBy(*PIXEL).agg(F.stddev_pop("value").alias(name))


def latest_image(images: DataFrame) -> DataFrame:
    """Pixels of the newest image of each collection, undated ones last; equal times are averaged.

    A collection's pixels are dealt to buckets by their place and its newest time goes to each bucket.
    """
    buckets = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b")
    newest = images.groupBy("collection").agg(F.max("ts").alias("_ts")).select(F.col("collection").alias("_c"), "_ts", every)
    bucket = F.pmod(F.xxhash64("row", "col"), F.lit(buckets)).cast("int")
    on = F.col("collection").eqNullSafe(F.col("_c")) & F.col("ts").eqNullSafe(F.col("_ts")) & (bucket == F.col("_b"))
    return images.join(newest, on, "left_semi").groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def monthly_climatology(images: DataFrame) -> DataFrame:
    """Mean per calendar month, then mean of the months present."""
    monthly = images.groupBy(*PIXEL, F.month("ts").alias("month")).agg(F.avg("value").alias("value"))
    return monthly.groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def total_over_time(images: DataFrame) -> DataFrame:
    return images.groupBy(*PIXEL).agg(F.sum("value").alias("value"))


@dataclass(frozen=True)
class Product:
    """One exported image: what to select and how to reduce it."""

    name: str
    collection: str
    bands: tuple[str, ...]
    reducer: str
    start: str | None = IMAGERY_START
    end: str | None = IMAGERY_END


UNDATED = (None, None)

# The named image products and their reducers; undated ones are single images.
PRODUCTS = (
    Product("poptotal", "population", ("population",), "latest", *UNDATED),
    Product("precip_mean", "precipitation", ("precipitation",), "mean"),
    Product("precip_std", "precipitation", ("precipitation",), "stddev"),
    Product("precip_acc", "terraclimate", ("pr",), "mean"),
    Product("evapotranspiration", "terraclimate", ("aet",), "mean"),
    Product("drought", "terraclimate", ("pdsi",), "latest"),
    Product("landcover", "landcover", ("discrete_classification",), "mean"),
    Product("built", "settlement", ("built", "cnfd"), "latest", *UNDATED),
    Product("ndwi", "water_index", ("NDWI",), "mean"),
    Product("ndvi", "vegetation_index", ("NDVI",), "mean"),
    Product("pollution", "aerosol", ("Optical_Depth_047", "Optical_Depth_055"), "monthly"),
    Product("elevation", "elevation", ("elevation",), "latest", *UNDATED),
    Product("slope", "elevation", ("elevation",), "slope", *UNDATED),
    Product("nightlight", "nightlight", ("avg_rad", "cf_cvg"), "mean"),
    Product("health_access", "accessibility", ("accessibility",), "latest", *UNDATED),
)

REDUCERS = {
    "mean": mean_over_time,
    "stddev": stddev_over_time,
    "latest": latest_image,
    "monthly": monthly_climatology,
    "sum": total_over_time,
}


def build_product(images: DataFrame, product: Product, meta: DataFrame | None = None) -> DataFrame:
    """``(product, band, row, col, value)`` of one named product, as 32-bit floats widened again."""
    from terracell.operators.raster import slope_degrees

    chosen = select_bands(
        between_dates(images.filter(F.col("collection") == product.collection), product.start, product.end),
        product.bands,
    )
    if product.reducer == "slope":
        if meta is None:
            raise ValueError("slope needs the raster metadata")
        base = latest_image(chosen).withColumnsRenamed({"collection": "raster"})
        out = slope_degrees(base, meta, "value").select(
            F.lit("slope").alias("band"), "row", "col", F.col("slope").alias("value")
        )
    else:
        out = REDUCERS[product.reducer](chosen)
    return out.select(
        F.lit(product.name).alias("product"), "band", "row", "col", F.col("value").cast("float").cast("double").alias("value")
    )


def build_products(images: DataFrame, products: Sequence[Product] = PRODUCTS, meta: DataFrame | None = None) -> DataFrame:
    parts = [build_product(images, p, meta) for p in products]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
