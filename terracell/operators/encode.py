"""Image patches to low-dimensional features."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.util import known


def fill_patches(patches: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Missing pixels get twice the overall minimum, pushed below every real value."""
    clean = F.transform(pixels, lambda v: known(v))
    lowest = patches.select(F.min(F.array_min(clean))).scalar()
    fill = F.when(lowest < 0, F.lit(2.0) * lowest).otherwise(F.lit(-2.0) * lowest)
    return patches.withColumn("_f", fill).withColumn(
        pixels, F.transform(clean, lambda v: F.coalesce(v, F.col("_f")))
    ).drop("_f")


def channels_last(pixels: Column, bands: int, height: int, width: int) -> Column:
    """Band-major array reordered to pixel-major."""
    size = height * width
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands * size - 1)),
        lambda i: F.get(pixels, (F.pmod(i, F.lit(bands)) * size + F.floor(i / bands)).cast("int")),
    )


def standardize_patches(patches: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Zero mean and unit population deviation of the known values of each position.

    Missing pixels (null or NaN) stay missing; constant positions become zero. The means travel as
    one array with an entry for each position.
    """
    clean = F.transform(pixels, lambda v: known(v))
    by_position = (
        patches.select(F.posexplode(clean).alias("at", "v"))
        .groupBy("at")
        .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
    )
    stats = by_position.select(F.sort_array(F.collect_list(F.struct("at", "mean", "spread")))).scalar()

    def scaled(v: Column, i: Column) -> Column:
        s = F.get(F.col("_stats"), i)
        return F.when(v.isNotNull(), F.when(s["spread"] > 0, (v - s["mean"]) / s["spread"]).otherwise(0.0))

    return patches.withColumn("_stats", stats).withColumn(pixels, F.transform(clean, scaled)).drop("_stats")


def encode_patches(patches: DataFrame, k: int = 32, pixels: str = "pixels", key: str = "hex_code") -> DataFrame:
    """``(key, f_0 .. f_{k-1})``: standardised patches on their first k principal components."""
    ready = fill_patches(standardize_patches(patches, pixels), pixels)
    vec = ready.select(key, array_to_vector(pixels).alias("_v"))
    coded = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec).transform(vec)
    parts = vector_to_array("_p")
    return coded.select(key, *[F.get(parts, F.lit(i)).alias(f"f_{i}") for i in range(k)])


def band_triplets(pixels: Column, bands: int, size: int) -> list[Column]:
    """Slices of three bands; the last is padded with zero bands."""
    out = []
    for start in range(0, bands, 3):
        have = min(3, bands - start)
        part = F.slice(pixels, start * size + 1, have * size)
        if have < 3:
            part = F.concat(part, F.array_repeat(F.lit(0.0), (3 - have) * size))
        out.append(part)
    return out


def triplet_features(
    patches: DataFrame, bands: int, size: int, k: int, pixels: str = "pixels", key: str = "hex_code"
) -> DataFrame:
    """PCA per band triplet: ``ceil(bands / 3) * k`` columns named ``t{triplet}_{component}``."""
    out = patches
    for n, part in enumerate(band_triplets(F.col(pixels), bands, size)):
        block = f"_t{n}"
        out = fill_patches(standardize_patches(out.withColumn(block, part), block), block)
        out = out.withColumn(f"_v{n}", array_to_vector(block))
        out = PCA(k=k, inputCol=f"_v{n}", outputCol=f"_p{n}").fit(out).transform(out)
    n_triplets = -(-bands // 3)
    cols = [
        F.get(vector_to_array(f"_p{n}"), F.lit(i)).alias(f"t{n}_{i}") for n in range(n_triplets) for i in range(k)
    ]
    return out.select(key, *cols)
