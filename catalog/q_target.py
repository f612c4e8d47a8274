"""Survey, target and cell-aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import (
    sql_area,
    sql_axial,
    sql_cell_lat,
    sql_cell_long,
    sql_disk,
    v_conflict,
    v_road,
    v_survey,
    v_tile,
    v_tower,
    with_views,
)
from terracell.functions import grid
from terracell.operators import aggregates as agg
from terracell.operators import columns as cols
from terracell.plans.target import create_target, keyed_survey
from terracell.schema import RADIOS

SEV = [
    "dep_water_sev",
    "dep_housing_sev",
    "dep_education_sev",
    "dep_sanitation_sev",
    "sumpoor_sev",
    "deprived_sev",
]
FLAGS = ", ".join(
    f"cast(coalesce(sumpoor_sev >= {k}, false) AS double) AS dep_{k}_or_more_sev" for k in (2, 3, 4)
)
ALL_SEV = SEV + [f"dep_{k}_or_more_sev" for k in (2, 3, 4)]
OTHER = ["hhid", "cluster", "age", "latnum", "longnum", "location"]


def africa(res: int = 3) -> str:
    return sql_axial("latnum", "longnum", res, f"""(SELECT *, {FLAGS} FROM v_survey
        WHERE trim(countrycode) = 'AFRICA' AND latnum IS NOT NULL AND longnum IS NOT NULL)""")


def all_rows(res: int) -> str:
    return sql_axial("latnum", "longnum", res, f"(SELECT *, {FLAGS} FROM v_survey WHERE latnum IS NOT NULL)")


def mean_of(c: str) -> str:
    """Means of the lattice coordinates often end exactly half way between two sixth digits, where
    the order of summing decides the rounding; in radians they do not."""
    return f"round(radians(avg({c})), 6)" if c in ("latnum", "longnum") else f"round(avg({c}), 6)"


def in_radians(df, *names):
    return df.withColumns({c: F.radians(c) for c in names})


def survey_cells(spark, d, res):
    s = v_survey(spark, d).na.drop(subset=["latnum", "longnum"])
    return cols.k_or_more(s).withColumn("hex_code", grid.cell_of("latnum", "longnum", res))


@query(
    "S1 P1 P2 P3 P5 G1 A1 A2 P7 G2 J3 Z1 Y2",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, count(survey) AS survey,
        {', '.join(f'{mean_of(c)} AS {c}' for c in OTHER + ALL_SEV)},
        round({sql_cell_lat('hex_code', 3)}, 6) AS lat, round({sql_cell_long('hex_code', 3)}, 6) AS long
        FROM ({africa()}) GROUP BY hex_code HAVING count(survey) >= 10""",
    ),
)
def target_by_cell(spark, d):
    t = create_target(v_survey(spark, d), "AFRICA", res=3, threshold=10)
    return rounded(in_radians(t, "latnum", "longnum"))


def _short(c: str, kind: str) -> str:
    return cols.short_names([f"{c}_{kind}"]).get(f"{c}_{kind}", f"{c}_{kind}")


@query(
    "G4 G5 A3 P10 P12 P14 F13 Y3 Z1",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, {', '.join(f'{mean_of(c)} AS "{_short(c, "mean")}"' for c in OTHER + ALL_SEV)},
        {', '.join(f'count({c}) AS "{_short(c, "count")}"' for c in ALL_SEV)},
        round({sql_cell_lat('hex_code', 3)}, 6) AS lat, round({sql_cell_long('hex_code', 3)}, 6) AS long
        FROM (SELECT s.* EXCLUDE (hex_code), s.hex_code + o.step AS hex_code FROM ({africa()}) s, {sql_disk(2)} o
            WHERE o.dist <= CASE WHEN s.location = 1 THEN 1 ELSE 2 END)
        GROUP BY hex_code HAVING count(sumpoor_sev) >= 30""",
    ),
)
def target_expanded(spark, d):
    t = create_target(v_survey(spark, d), "AFRICA", res=3, threshold=30, copy_to_nbrs=True)
    return rounded(in_radians(t, "latnum_mean", "longnum_mean"))


@query(
    "P11 P16",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ['age'] + ALL_SEV)}
        FROM (SELECT s.* EXCLUDE (hex_code), s.hex_code + o.step AS hex_code FROM ({africa()}) s, {sql_disk(2)} o
            WHERE o.dist <= CASE WHEN s.location = 1 THEN 1 ELSE 2 END)
        GROUP BY hex_code HAVING count(sumpoor_sev) >= 30""",
    ),
)
def expanded_dataset_names(spark, d):
    t = create_target(v_survey(spark, d), "AFRICA", res=3, threshold=30, copy_to_nbrs=True)
    return rounded(cols.rename_long(t.drop(*cols.matching(t, "_count$"))).select("hex_code", "age", *ALL_SEV))


@query(
    "A4 P6 P8",
    with_views(
        ["v_conflict"],
        f"""SELECT hex_code, count(*) AS n_conflicts FROM ({sql_axial('latitude', 'longitude', 4, "(SELECT * FROM v_conflict WHERE country = 'ASIA')")})
        GROUP BY hex_code""",
    ),
)
def conflicts_by_cell(spark, d):
    c = v_conflict(spark, d).filter(F.col("country") == "ASIA")
    c = c.withColumn("hex_code", grid.cell_of("latitude", "longitude", 4))
    return agg.aggregate_hexagon(c, "event_id", "n_conflicts", "count")


@query(
    "A5 J7 Z4 G10",
    with_views(
        ["v_road"],
        f"""SELECT hex_code, round(sum(length) / 1000e0, 6) AS length_km,
        round(sum(length) / 1000e0 / {sql_area(4)}, 6) AS road_density
        FROM ({sql_axial('lat', 'lon', 4, 'v_road')}) GROUP BY hex_code""",
    ),
)
def road_density(spark, d):
    r = v_road(spark, d).withColumn("hex_code", grid.cell_of("lat", "lon", 4))
    return rounded(agg.density_per_cell(r, "length", 4))


@query(
    "A6 A7",
    with_views(
        ["v_tower"],
        f"""SELECT hex_code, {', '.join(f"count(*) FILTER (radio = '{x}') AS {x}" for x in RADIOS)},
        round(avg(avg_signal), 6) AS avg_signal FROM ({sql_axial('lat', 'long', 4, 'v_tower')}) GROUP BY hex_code""",
    ),
)
def towers_by_cell(spark, d):
    t = v_tower(spark, d).withColumn("hex_code", grid.cell_of("lat", "long", 4))
    return rounded(agg.category_counts(t, "radio", RADIOS, {"avg_signal": F.avg("avg_signal")}))


@query(
    "A9",
    with_views(
        ["v_tile"],
        f"""SELECT hex_code, round(avg(avg_d_kbps), 6) AS avg_d_kbps, cast(sum(avg_u_kbps) AS BIGINT) AS avg_u_kbps
        FROM ({sql_axial('lat', 'lon', 3, 'v_tile')}) GROUP BY hex_code""",
    ),
)
def mixed_aggregate(spark, d):
    t = v_tile(spark, d).withColumn("hex_code", grid.cell_of("lat", "lon", 3))
    return rounded(agg.aggregate_mixed(t, {"avg_d_kbps": "avg", "avg_u_kbps": "sum"}))


@query("A11 T1", with_views(["v_survey"], "SELECT survey, count(*) AS n FROM v_survey GROUP BY survey"))
def value_counts(spark, d):
    s = v_survey(spark, d)
    return s.groupBy("survey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "survey")


@query(
    "A12 T1",
    with_views(
        ["v_survey"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM v_survey HAVING count(*) - count({c}) > 0"
            for c in OTHER + SEV
        ),
    ),
)
def missing_counts(spark, d):
    return agg.missing_counts(v_survey(spark, d), above=0, columns=OTHER + SEV).orderBy("missing")


@query(
    "A13",
    with_views(
        ["v_survey"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM v_survey" for c in ["survey", "cluster", "age", "latnum"]
        ),
    ),
)
def distinct_counts(spark, d):
    return agg.distinct_counts(v_survey(spark, d), ["survey", "cluster", "age", "latnum"])


@query(
    "A14 J9",
    with_views(
        ["v_survey"],
        f"""SELECT a.hex_code, string_agg(b.n, ',' ORDER BY b.n) AS values FROM cells a, {sql_disk(1)} o, cells b
        WHERE o.dist = 1 AND b.hex_code = a.hex_code + o.step GROUP BY a.hex_code""",
        [("cells", f"SELECT hex_code, count(*) AS n FROM ({all_rows(3)}) GROUP BY hex_code")],
    ),
)
def neighbour_lists(spark, d):
    cells = survey_cells(spark, d, 3).groupBy("hex_code").agg(F.count(F.lit(1)).alias("n"))
    lists = agg.neighbour_lists(cells, 1, "n")
    return lists.select("hex_code", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@query(
    "A15",
    with_views(
        ["v_survey"],
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", cast(count({c}) AS double) AS "count", round(avg({c}), 6) AS mean,
            round(stddev_samp({c}), 6) AS stddev, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max FROM v_survey"""
            for c in ["age", "sumpoor_sev", "dep_water_sev"]
        ),
    ),
)
def describe(spark, d):
    return rounded(agg.describe(v_survey(spark, d), ["age", "sumpoor_sev", "dep_water_sev"]))


@query(
    "A16 A20",
    with_views(
        ["v_survey"],
        """SELECT countrycode, round(avg(CASE WHEN sumpoor_sev <> 0 THEN 1e0 ELSE 0e0 END), 6) AS nonzero,
        round(avg(CASE WHEN age < 5 THEN 1e0 ELSE 0e0 END), 6) AS under5,
        round(avg(cast(dep_water_sev IS NULL AS int) + cast(dep_education_sev IS NULL AS int)), 6) AS missing
        FROM v_survey GROUP BY countrycode""",
    ),
)
def shares_and_row_missing(spark, d):
    s = v_survey(spark, d)
    preds = {"nonzero": F.col("sumpoor_sev") != 0, "under5": F.col("age") < 5}
    a = agg.share_where(s, preds, ["countrycode"])
    m = s.groupBy("countrycode").agg(F.avg(agg.row_missing(s, ["dep_water_sev", "dep_education_sev"])).alias("missing"))
    return rounded(a.join(m, "countrycode"))


COUNTS = ("cells", f"SELECT hex_code, count(*) AS n FROM ({all_rows(3)}) GROUP BY hex_code")


@query(
    "A17",
    with_views(
        ["v_survey"],
        " UNION ALL ".join(
            f"SELECT cast({c} AS BIGINT) AS cut, round(avg(CASE WHEN n < {c} THEN 1e0 ELSE 0e0 END), 6) AS share_lost FROM cells"
            for c in (5, 10, 15, 20, 30)
        ),
        [COUNTS],
    ),
)
def threshold_loss(spark, d):
    cells = survey_cells(spark, d, 3).groupBy("hex_code").agg(F.count(F.lit(1)).alias("n"))
    return rounded(agg.threshold_loss(cells, "n"))


@query("A17 F18", with_views(["v_survey"], "SELECT round(quantile_cont(n, 0.05), 6) AS q05 FROM cells", [COUNTS]))
def count_quantile(spark, d):
    cells = survey_cells(spark, d, 3).groupBy("hex_code").agg(F.count(F.lit(1)).alias("n"))
    return rounded(agg.quantile(cells, "n", 0.05, "q05"))


@query(
    "A18",
    "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem"
    " UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem"
    " UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem",
)
def correlation_pairs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(agg.correlation_pairs(li, ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "A19",
    with_views(["v_survey"], "SELECT min(latnum) AS min_latnum, min(longnum) AS min_longnum, max(latnum) AS max_latnum, max(longnum) AS max_longnum FROM v_survey"),
)
def extents(spark, d):
    return agg.extents(v_survey(spark, d), ["latnum", "longnum"])


@query(
    "A21 X15",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, round(avg(sumpoor_sev / nullif(4 - (cast(dep_water_sev IS NULL AS int) + cast(dep_education_sev IS NULL AS int)), 0)), 6) AS dep_sev_idx
        FROM ({all_rows(3)}) GROUP BY hex_code""",
    ),
)
def deprivation_index(spark, d):
    s = agg.deprivation_index(survey_cells(spark, d, 3), SEV[:4])
    return rounded(s.groupBy("hex_code").agg(F.avg("dep_sev_idx").alias("dep_sev_idx")))


@query(
    "A22",
    """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT cast(range AS BIGINT) AS bin FROM range(20)) b LEFT JOIN (
    SELECT cast(CASE WHEN o_totalprice = hi THEN 19 ELSE floor((o_totalprice - lo) * 20 / (hi - lo)) END AS BIGINT) AS bin, count(*) AS n
    FROM orders, e GROUP BY 1) h ON b.bin = h.bin""",
)
def histogram(spark, d):
    return rounded(agg.histogram(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 20))


@query(
    "A23",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, variable, round(value, 6) AS value FROM (
        SELECT hex_code, {', '.join(f'avg({c}) AS {c}' for c in SEV)} FROM ({all_rows(3)}) GROUP BY hex_code)
        UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(SEV)}))""",
    ),
)
def melt_targets(spark, d):
    cells = survey_cells(spark, d, 3).groupBy("hex_code").agg(*[F.avg(c).alias(c) for c in SEV])
    return rounded(agg.melt(cells, ["hex_code"], SEV))


@query(
    "A24 W3",
    with_views(
        ["v_survey"],
        f"""SELECT hex_code, hhid, survey FROM (SELECT *, row_number() OVER (PARTITION BY hex_code ORDER BY age DESC, hhid) AS rn
        FROM ({all_rows(4)})) WHERE rn = 1""",
    ),
)
def first_row_per_cell(spark, d):
    s = survey_cells(spark, d, 4).select("hex_code", "hhid", "survey", "age")
    return agg.keep_one(s, ["hex_code"], [-F.col("age"), F.col("hhid")]).drop("age")


@query(
    "A26",
    "SELECT l_linenumber, "
    + ", ".join(
        f"""round(avg(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS l_quantity_l_returnflag_{v}_mean,
        round(stddev_samp(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS l_quantity_l_returnflag_{v}_std,
        min(l_quantity) FILTER (l_returnflag = '{v}') AS l_quantity_l_returnflag_{v}_min,
        max(l_quantity) FILTER (l_returnflag = '{v}') AS l_quantity_l_returnflag_{v}_max,
        round(skewness(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS l_quantity_l_returnflag_{v}_skew"""
        for v in "ANR"
    )
    + " FROM (SELECT cast(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag FROM lineitem) GROUP BY l_linenumber",
)
def group_features(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(agg.group_features(li, "l_linenumber", "l_returnflag", ["A", "N", "R"], ["l_quantity"]))


@query(
    "A29",
    with_views(
        ["v_survey"],
        f"""SELECT a.hex_code, round(sum(b.n * b.x) / sum(CASE WHEN b.x IS NOT NULL THEN b.n END), 6) AS near_age
        FROM cells a, {sql_disk(1)} o, cells b WHERE b.hex_code = a.hex_code + o.step GROUP BY a.hex_code""",
        [("cells", f"SELECT hex_code, count(*) AS n, avg(age) AS x FROM ({all_rows(4)}) GROUP BY hex_code")],
    ),
)
def weighted_neighbour_mean(spark, d):
    cells = survey_cells(spark, d, 4).groupBy("hex_code").agg(F.count(F.lit(1)).alias("n"), F.avg("age").alias("x"))
    return rounded(agg.weighted_neighbour_mean(cells, "x", "n", 1, "near_age"))


@query(
    "M18 Z1",
    with_views(
        ["v_survey"],
        f"""SELECT trim(countrycode) AS country, hex_code, count(*) AS n, round(avg(dep_housing_sev), 6) AS housing
        FROM ({all_rows(3)}) GROUP BY 1, 2 HAVING count(*) >= 10""",
    ),
)
def all_countries_one_job(spark, d):
    s = survey_cells(spark, d, 3)
    out = s.groupBy(F.trim("countrycode").alias("country"), "hex_code").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dep_housing_sev").alias("housing")
    )
    return rounded(agg.at_least(out, "n", 10))
