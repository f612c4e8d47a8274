"""Column roles, source schemas and job settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

CELL = "hex_code"
TARGET_MARK = "survey"

SURVEY = T.StructType(
    [
        T.StructField("countrycode", T.StringType()),
        T.StructField("survey", T.StringType()),
        T.StructField("hhid", T.LongType()),
        T.StructField("cluster", T.LongType()),
        T.StructField("age", T.LongType()),
        T.StructField("latnum", T.DoubleType()),
        T.StructField("longnum", T.DoubleType()),
        T.StructField("location", T.IntegerType()),
        T.StructField("dep_housing_sev", T.DoubleType()),
        T.StructField("dep_water_sev", T.DoubleType()),
        T.StructField("dep_sanitation_sev", T.DoubleType()),
        T.StructField("dep_education_sev", T.DoubleType()),
        T.StructField("dep_health_sev", T.DoubleType()),
        T.StructField("dep_nutrition_sev", T.DoubleType()),
        T.StructField("sumpoor_sev", T.DoubleType()),
        T.StructField("deprived_sev", T.DoubleType()),
    ]
)

# The column order of the headerless cell-tower export.
TOWER_COLUMNS = [
    "radio",
    "mcc",
    "mnc",
    "lac",
    "cid",
    "range",
    "long",
    "lat",
    "sample",
    "changeable_1",
    "changeable_0",
    "created",
    "updated",
    "avg_signal",
]
TOWER = T.StructType(
    [
        T.StructField(
            c,
            T.StringType() if c == "radio" else T.DoubleType() if c in ("long", "lat", "avg_signal") else T.LongType(),
        )
        for c in TOWER_COLUMNS
    ]
)

CONFLICT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

ZONES = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("win_population", T.DoubleType()),
        T.StructField("win_roads_km", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
    ]
)

# Zone columns kept as features, after the suffix.
ZONE_FEATURES = ["name_commuting", "win_population_commuting", "win_roads_km_commuting", "area_commuting"]

SPEED_TILES = T.StructType(
    [
        T.StructField("avg_d_kbps", T.DoubleType()),
        T.StructField("avg_u_kbps", T.DoubleType()),
        T.StructField("geometry", T.StringType()),
    ]
)

ROADS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("highway", T.StringType()),
    ]
)

WEALTH = T.StructType(
    [
        T.StructField("quadkey", T.StringType()),
        T.StructField("rwi", T.DoubleType()),
        T.StructField("error", T.DoubleType()),
    ]
)

PIXELS = T.StructType(
    [
        T.StructField("raster", T.StringType()),
        T.StructField("band", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Defaults of the studied jobs.
DEFAULT_THRESHOLD = 30
DEFAULT_RES = 7
IMAGERY_START, IMAGERY_END = "2010-01-01", "2020-01-01"
ZERO_FILL = ["n_conflicts", "GSM", "LTE", "NR", "UMTS"]
RADIOS = ["CDMA", "GSM", "LTE", "NR", "UMTS"]
# The target columns that "all" stands for.
ALL_TARGETS = (
    "dep_housing_sev",
    "dep_water_sev",
    "dep_sanitation_sev",
    "dep_education_sev",
    "dep_2_or_more_sev",
    "sumpoor_sev",
    "deprived_sev",
)


@dataclass(frozen=True)
class Roles:
    """Which columns are features, targets, keys: names instead of positions."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    key: str = CELL
    weight: str | None = None

    def without(self, *names: str) -> "Roles":
        return replace(self, features=tuple(f for f in self.features if f not in names))


@dataclass(frozen=True)
class DatasetConfig:
    country_code: str
    country: str
    res: int = DEFAULT_RES
    threshold: int = DEFAULT_THRESHOLD
    lat: str = "latnum"
    long: str = "longnum"
    fill_zero: tuple[str, ...] = field(default_factory=lambda: tuple(ZERO_FILL))
