"""Readers with explicit schemas. NaN becomes null on every scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell import schema as s
from terracell.functions import geom
from terracell.operators.columns import lower_names, nan_to_null


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str | Sequence[str], kind: T.StructType, **options) -> DataFrame:
    """Headed CSV by column name; columns of the schema the file lacks are null.

    The first header decides the physical order, so the scan itself never infers; a file whose header
    differs stops the read. Whole numbers written as "3.0" are read as such.
    """
    plain = _headed(spark, path, options)
    have = {c.lower(): c for c in plain.columns}
    out = [
        (_parsed(have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in kind.fields
    ]
    return nan_to_null(plain.select(*out))


def _headed(spark: SparkSession, path: str | Sequence[str], options: dict) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    names = spark.read.option("header", True).options(**options).csv(paths).columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.schema(texts).option("header", True).option("enforceSchema", False).options(**options).csv(paths)


def _parsed(name: str, kind: T.DataType) -> Column:
    text = F.col(f"`{name}`")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(text.try_cast(kind), whole)
    return text.try_cast(kind)


def read_survey(spark: SparkSession, path: str, landing: bool = False) -> DataFrame:
    """Survey microdata from CSV, or from the Parquet it was landed to; other numeric columns stay."""
    if path.endswith(".parquet") or landing:
        return nan_to_null(lower_names(spark.read.parquet(path)))
    plain = _headed(spark, path, {})
    have = {c.lower(): c for c in plain.columns}
    listed = {f.name for f in s.SURVEY.fields}
    numeric = _numeric_columns(plain, [c for low, c in have.items() if low not in listed])
    out = [
        (_parsed(have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in s.SURVEY.fields
    ]
    return nan_to_null(plain.select(*out, *[_parsed(c, T.DoubleType()).alias(c.lower()) for c in numeric]))


def _numeric_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the text columns whose values are all numbers, with one value at least: one scan."""
    if not names:
        return []
    text = [F.col(f"`{c}`") for c in names]
    row = df.agg(
        *[F.count(t).alias(f"n{i}") for i, t in enumerate(text)],
        *[F.count(t.try_cast("double")).alias(f"d{i}") for i, t in enumerate(text)],
    ).first()
    return [c for i, c in enumerate(names) if 0 < row[f"n{i}"] == row[f"d{i}"]]


def read_towers(spark: SparkSession, path: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """All headerless quoted gzip files of a country; malformed lines are dropped.

    A gzip file is one task, so the rows are dealt out again before any work on them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.schema(s.TOWER).option("mode", "DROPMALFORMED").option("quote", '"').csv(paths)
    n = parts or spark.sparkContext.defaultParallelism
    return nan_to_null(rows).repartition(n)


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, s.CONFLICT)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones with a stable key in front of the polygon text."""
    rows = read_csv(spark, path, s.ZONES, multiLine="true", quote='"', escape='"')
    return rows.withColumn("zone_id", F.xxhash64("country", "name", "geometry"))


def read_speed_tiles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, s.SPEED_TILES, quote='"')


def read_roads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab separated road segments; ``@id @lat @lon length highway``."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(s.ROADS).option("header", True).option("sep", "\t").option("enforceSchema", True).csv(paths)


def read_wealth(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, s.WEALTH)


def read_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None) -> DataFrame:
    """Pixel table stored by (raster, band); a band list prunes folders."""
    rows = spark.read.schema(s.PIXELS).parquet(path)
    return nan_to_null(rows if bands is None else rows.filter(F.col("band").isin(list(bands))))


def read_geojson(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Features of all files: properties, kind, coordinates as JSON text, and parts of polygons."""
    kind = T.StructType(
        [
            T.StructField(
                "features",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                            T.StructField(
                                "geometry",
                                T.StructType(
                                    [
                                        T.StructField("type", T.StringType()),
                                        T.StructField("coordinates", T.StringType()),
                                    ]
                                ),
                            ),
                        ]
                    )
                ),
            )
        ]
    )
    rows = spark.read.schema(kind).option("multiLine", True).json(path if isinstance(path, str) else list(path))
    flat = rows.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    return flat.withColumn("parts", geom.parse_geojson("type", "coordinates"))


def read_datasets(
    spark: SparkSession, root: str, res: int, threshold: int, countries: Sequence[str] | None = None
) -> DataFrame:
    """Datasets of all or some countries; the filters prune partitions."""
    rows = spark.read.option("mergeSchema", True).parquet(root).filter(
        (F.col("res") == res) & (F.col("threshold") == threshold)
    )
    return rows if countries is None else rows.filter(F.col("country").isin([c.lower() for c in countries]))
