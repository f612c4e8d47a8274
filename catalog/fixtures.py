"""Views over the given tables with the shape of the engine's inputs.

``view(spark, d, name)`` builds one as a DataFrame; ``with_views(names, body)`` prefixes the same
views, as common table expressions, to an oracle statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions.grid import CELL_AREA_KM2, EARTH_KM, SQRT3, cell_radius_km


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lat(k: Column) -> Column:
    return F.lit(4.2) + (k * 7919 % 9600) / F.lit(1000.0)


def _long(k: Column) -> Column:
    return F.lit(2.7) + (k * 104729 % 12000) / F.lit(1000.0)


def v_site(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", _lat(k).alias("lat"), _long(k).alias("lon")
    )


def v_survey(spark, d):
    site, orders = v_site(spark, d), table(spark, d, "orders")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    j = (
        orders.join(site, orders["o_custkey"] == site["c_custkey"])
        .join(nation, F.col("c_nationkey") == nation["n_nationkey"])
        .join(region, F.col("n_regionkey") == region["r_regionkey"])
    )
    h = F.col("o_orderkey")
    placed = F.col("c_custkey") % 50 != 7

    def flag(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)

    base = j.select(
        h.alias("hhid"),
        F.col("c_custkey").alias("cluster"),
        F.col("o_orderpriority").alias("survey"),
        F.concat("r_name", F.lit(" ")).alias("countrycode"),
        (h % 18).alias("age"),
        F.when(placed, F.col("lat")).alias("latnum"),
        F.when(placed, F.col("lon")).alias("longnum"),
        F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("location"),
        F.when(h % 11 != 0, flag(h * 37 % 100 < F.lit(100.0) * (F.col("lon") - 2.7) / 12)).alias("dep_water_sev"),
        flag(h * 53 % 100 < F.lit(100.0) * (F.col("lat") - 4.2) / 9.6).alias("dep_housing_sev"),
        F.when(h % 13 != 0, flag(h * 71 % 100 < 40)).alias("dep_education_sev"),
        flag(h * 29 % 100 < F.lit(100.0) * (F.lit(14.7) - F.col("lon")) / 12).alias("dep_sanitation_sev"),
    )
    total = sum(
        F.coalesce(F.col(f"dep_{n}_sev"), F.lit(0.0))
        for n in ("water", "housing", "education", "sanitation")
    )
    return base.withColumn("sumpoor_sev", F.when(F.col("hhid") % 101 != 0, total)).withColumn(
        "deprived_sev",
        F.when(F.col("sumpoor_sev").isNotNull(), flag(F.col("sumpoor_sev") >= 1)),
    )


def v_zone(spark, d):
    n = F.col("n_nationkey")
    x0, y0 = F.lit(2) + 3 * (n % 5), F.lit(4) + 2 * F.floor(n / 5)
    pts = [(x0, y0), (x0 + 3, y0), (x0 + 3, y0 + 2), (x0, y0 + 2), (x0, y0)]
    text = F.concat_ws(
        ", ", *[F.concat_ws(" ", x.cast("int").cast("string"), y.cast("int").cast("string")) for x, y in pts]
    )
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        n.alias("zone_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("country"),
        F.concat(F.lit("POLYGON (("), text, F.lit("))")).alias("geometry"),
    )


def v_tile(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        _lat(k).alias("lat"),
        _long(k).alias("lon"),
        F.col("p_retailprice").alias("avg_d_kbps"),
        F.col("p_size").alias("avg_u_kbps"),
    )


def v_tile_wkt(spark, d):
    """Tiles as the speed-test source holds them: kbps and polygon text, NW corner first."""
    t = v_tile(spark, d)
    x0, y1 = F.col("lon"), F.col("lat")
    x1, y0 = x0 + F.lit(0.05), y1 - F.lit(0.05)

    def pair(x, y):
        return F.format_string("%.3f %.3f", x, y)

    ring = [pair(x0, y1), pair(x1, y1), pair(x1, y0), pair(x0, y0), pair(x0, y1)]
    return t.select(
        "p_partkey",
        F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))")).alias("geometry"),
        F.col("avg_d_kbps"),
        F.col("avg_u_kbps"),
    )


def v_tower(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    radio = (
        F.when(t == "view", "GSM")
        .when(t == "click", "LTE")
        .when(t == "signup", "UMTS")
        .when(t == "purchase", "NR")
        .when(t == "error", "CDMA")
    )
    return table(spark, d, "events").select(
        radio.alias("radio"), F.col("value").alias("avg_signal"), _lat(k).alias("lat"), _long(k).alias("long")
    )


def v_conflict(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type") == "error")
    r = table(spark, d, "region")
    k = F.col("event_id")
    return e.join(r, e["user_id"] % 5 == r["r_regionkey"]).select(
        "event_id", F.col("r_name").alias("country"), _lat(k).alias("latitude"), _long(k).alias("longitude")
    )


def v_road(spark, d):
    k = F.col("l_partkey") * 101 + F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        _lat(k).alias("lat"),
        _long(k).alias("lon"),
        F.col("l_extendedprice").alias("length"),
        F.col("l_returnflag").alias("highway"),
    )


def v_pixel(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        # always r1, but read from the data: a literal would turn joins on it into loops
        F.format_string("r%d", F.signum(k + 1).cast("int")).alias("raster"),
        F.floor(k / 150).cast("long").alias("row"),
        (k % 150).alias("col"),
        F.when(k % 17 == 0, F.lit(-9999.0)).otherwise(F.col("o_totalprice")).alias("b1"),
        F.when(k % 19 != 0, (k % 7).cast("double")).alias("b2"),
    )


def v_raster(spark, d):
    """One metadata row for r1; its height comes from the pixel table."""
    rows = v_pixel(spark, d).groupBy("raster").agg((F.max("row") + 1).alias("height"))
    return rows.select(
        "raster",
        F.lit("EPSG:4326").alias("crs"),
        F.lit(0.08).alias("a"),
        F.lit(0.0).alias("b"),
        F.lit(2.7).alias("c"),
        F.lit(0.0).alias("d"),
        (F.lit(-9.6) / F.col("height")).alias("e"),
        F.lit(13.8).alias("f"),
        F.lit(150).cast("long").alias("width"),
        "height",
        F.lit(-9999.0).alias("nodata"),
        F.lit(2).cast("long").alias("n_bands"),
    )


def v_imagery(spark, d):
    return table(spark, d, "lineitem").select(
        F.lit("c1").alias("collection"),
        F.lit("q").alias("band"),
        F.col("l_shipdate").alias("ts"),
        F.floor(F.col("l_partkey") / 50).cast("long").alias("row"),
        (F.col("l_partkey") % 50).alias("col"),
        F.col("l_quantity").alias("value"),
    )


def v_patch(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("hex_code"), F.col("embedding").cast("array<double>").alias("pixels"), "label"
    )


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return globals()[name](spark, d)


def lit(v: float) -> str:
    """A double literal for the oracle engine (a bare decimal point would be a decimal)."""
    return f"{float(v):.17e}"


def sql_lat(k: str) -> str:
    return f"(4.2e0 + (({k}) * 7919 % 9600) / 1000e0)"


def sql_long(k: str) -> str:
    return f"(2.7e0 + (({k}) * 104729 % 12000) / 1000e0)"


_SEV_TOTAL = " + ".join(
    f"coalesce(dep_{n}_sev, 0e0)" for n in ("water", "housing", "education", "sanitation")
)

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_site": ([], f"SELECT c_custkey, c_nationkey, {sql_lat('c_custkey')} AS lat, {sql_long('c_custkey')} AS lon FROM customer"),
    "v_survey_flags": (
        ["v_site"],
        """SELECT o_orderkey AS hhid, c_custkey AS cluster, o_orderpriority AS survey,
            r_name || ' ' AS countrycode, o_orderkey % 18 AS age,
            CASE WHEN c_custkey % 50 <> 7 THEN lat END AS latnum,
            CASE WHEN c_custkey % 50 <> 7 THEN lon END AS longnum,
            CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS location,
            CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey * 37 % 100 < 100e0 * (lon - 2.7e0) / 12e0 THEN 1e0 ELSE 0e0 END END AS dep_water_sev,
            CASE WHEN o_orderkey * 53 % 100 < 100e0 * (lat - 4.2e0) / 9.6e0 THEN 1e0 ELSE 0e0 END AS dep_housing_sev,
            CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_orderkey * 71 % 100 < 40 THEN 1e0 ELSE 0e0 END END AS dep_education_sev,
            CASE WHEN o_orderkey * 29 % 100 < 100e0 * (14.7e0 - lon) / 12e0 THEN 1e0 ELSE 0e0 END AS dep_sanitation_sev
        FROM orders JOIN v_site ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    ),
    "v_survey_sum": (
        ["v_survey_flags"],
        f"SELECT *, CASE WHEN hhid % 101 <> 0 THEN {_SEV_TOTAL} END AS sumpoor_sev FROM v_survey_flags",
    ),
    "v_survey": (
        ["v_survey_sum"],
        """SELECT *, CASE WHEN sumpoor_sev IS NOT NULL THEN CASE WHEN sumpoor_sev >= 1 THEN 1e0 ELSE 0e0 END END AS deprived_sev
        FROM v_survey_sum""",
    ),
    "v_zone": (
        [],
        """SELECT n_nationkey AS zone_id, n_name AS name, r_name AS country,
            2 + 3 * (n_nationkey % 5) AS x0, 4 + 2 * (n_nationkey // 5) AS y0,
            5 + 3 * (n_nationkey % 5) AS x1, 6 + 2 * (n_nationkey // 5) AS y1
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "v_tile": (
        [],
        f"""SELECT p_partkey, {sql_lat('p_partkey')} AS lat, {sql_long('p_partkey')} AS lon,
            p_retailprice AS avg_d_kbps, p_size AS avg_u_kbps FROM part""",
    ),
    "v_tower": (
        [],
        f"""SELECT CASE event_type WHEN 'view' THEN 'GSM' WHEN 'click' THEN 'LTE' WHEN 'signup' THEN 'UMTS'
            WHEN 'purchase' THEN 'NR' WHEN 'error' THEN 'CDMA' END AS radio, value AS avg_signal,
            {sql_lat('event_id')} AS lat, {sql_long('event_id')} AS long FROM events""",
    ),
    "v_conflict": (
        [],
        f"""SELECT event_id, r_name AS country, {sql_lat('event_id')} AS latitude, {sql_long('event_id')} AS longitude
        FROM events JOIN region ON user_id % 5 = r_regionkey WHERE event_type = 'error'""",
    ),
    "v_road": (
        [],
        f"""SELECT {sql_lat('l_partkey * 101 + l_suppkey')} AS lat, {sql_long('l_partkey * 101 + l_suppkey')} AS lon,
            l_extendedprice AS length, l_returnflag AS highway FROM lineitem""",
    ),
    "v_pixel": (
        [],
        """SELECT 'r1' AS raster, o_orderkey // 150 AS row, o_orderkey % 150 AS col,
            CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS b1,
            CASE WHEN o_orderkey % 19 <> 0 THEN cast(o_orderkey % 7 AS double) END AS b2 FROM orders""",
    ),
    "v_pixel_at": (
        ["v_pixel"],
        """SELECT p.*, 2.7e0 + 0.08e0 * (col + 0.5e0) AS long,
            13.8e0 + (-9.6e0 / (SELECT max(row) + 1 FROM v_pixel)) * (row + 0.5e0) AS lat FROM v_pixel p""",
    ),
    "v_imagery": (
        [],
        """SELECT 'c1' AS collection, 'q' AS band, l_shipdate AS ts, l_partkey // 50 AS row,
            l_partkey % 50 AS col, l_quantity AS value FROM lineitem""",
    ),
    "v_patch": ([], "SELECT vec_id AS hex_code, embedding AS pixels, label FROM embeddings"),
}


def sql_axial(lat: str, long: str, res: int, source: str, keep: str = "*") -> str:
    """The source with its ``hex_code`` added, as plain nested selects (no correlation)."""
    s = lit(cell_radius_km(res))
    return f"""SELECT * EXCLUDE (px, py, qf, rf, sf, rq, rr, rs, dq, dr, ds),
        CASE WHEN qf IS NOT NULL THEN {res * (1 << 56)}
        + (CAST(CASE WHEN dq > ds AND dq > dr THEN -rs - rr ELSE rq END AS BIGINT) + 134217728) * 268435456
        + (CAST(CASE WHEN dq > ds AND dq > dr THEN rr WHEN ds > dr THEN rr ELSE -rq - rs END AS BIGINT) + 134217728)
        END AS hex_code FROM (
        SELECT *, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs - sf) AS ds FROM (
        SELECT *, floor(qf + 0.5e0) AS rq, floor(rf + 0.5e0) AS rr, floor(sf + 0.5e0) AS rs FROM (
        SELECT *, -qf - rf AS sf FROM (
        SELECT *, ({lit(SQRT3 / 3)} * px - py / 3e0) / {s} AS qf, (2e0 * py / 3e0) / {s} AS rf FROM (
        SELECT {keep}, {lit(EARTH_KM)} * radians({long}) AS px, {lit(EARTH_KM)} * sin(radians({lat})) AS py FROM {source})))))"""


def sql_q(cell: str) -> str:
    return f"((({cell}) // 268435456) % 268435456 - 134217728)"


def sql_r(cell: str) -> str:
    return f"(({cell}) % 268435456 - 134217728)"


def sql_cell_lat(cell: str, res: int) -> str:
    return f"degrees(asin(1.5e0 * {lit(cell_radius_km(res))} * {sql_r(cell)} / {lit(EARTH_KM)}))"


def sql_cell_long(cell: str, res: int) -> str:
    return (
        f"degrees({lit(cell_radius_km(res))} * {lit(SQRT3)} * ({sql_q(cell)} + {sql_r(cell)} / 2e0) / {lit(EARTH_KM)})"
    )


def sql_disk(k: int) -> str:
    """Table of id offsets within k steps."""
    return f"""(SELECT dq * 268435456 + dr AS step, cast((abs(dq) + abs(dr) + abs(dq + dr)) / 2 AS BIGINT) AS dist
        FROM range(-{k}, {k + 1}) a(dq), range(-{k}, {k + 1}) b(dr) WHERE abs(dq + dr) <= {k})"""


def sql_area(res: int) -> str:
    return lit(CELL_AREA_KM2[res])


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    seen: list[str] = []

    def visit(name: str) -> None:
        deps, _ = VIEWS[name]
        for dep in deps:
            visit(dep)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in seen] + [f"{n} AS ({t})" for n, t in extra]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
