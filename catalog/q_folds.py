"""Split, fold and sampling queries. Orders are md5 based, so both engines shuffle alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import sql_axial, v_site, v_survey, v_zone, with_views
from terracell.functions import grid
from terracell.operators import folds, spatial

H = "md5(concat_ws('|', cast({} AS VARCHAR), '42'))"


def sites(spark, d):
    return v_site(spark, d).select("c_custkey", "c_nationkey", "lat", F.col("lon").alias("long"))


def truth(spark, d):
    """Housing deprivation by (country, cell) with the survey count."""
    s = v_survey(spark, d).filter("latnum IS NOT NULL").withColumn("hex_code", grid.cell_of("latnum", "longnum", 3))
    return s.groupBy(F.trim("countrycode").alias("country"), "hex_code").agg(
        F.avg("dep_housing_sev").alias("truth"), ((F.avg("latnum") - 4.2) / 9.7).alias("pred"), F.count(F.lit(1)).alias("weight")
    )


TRUTH = (
    "t",
    f"""SELECT trim(countrycode) AS country, hex_code, avg(dep_housing_sev) AS truth, (avg(latnum) - 4.2e0) / 9.7e0 AS pred, count(*) AS weight
    FROM ({sql_axial('latnum', 'longnum', 3, '(SELECT * FROM v_survey WHERE latnum IS NOT NULL)')}) GROUP BY 1, 2""",
)


@query(
    "C1",
    f"""SELECT o_orderkey, cast(row_number() OVER (ORDER BY {H.format('o_orderkey')}) <= ceil((SELECT count(*) FROM orders) * 0.2e0) AS BIGINT) AS is_test FROM orders""",
)
def random_holdout(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return rounded(folds.random_holdout(o, ["o_orderkey"], 0.2))


@query("C2 C9", f"SELECT o_orderkey, (row_number() OVER (ORDER BY {H.format('o_orderkey')}) - 1) % 5 AS fold FROM orders")
def random_folds(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return rounded(folds.cv_folds(o, "normal", 5, keys=["o_orderkey"]))


@query(
    "C3 F17 W4",
    f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    c AS (SELECT o_orderkey, {' + '.join(f'cast(o_totalprice > lo + (hi - lo) * {i} / 5 AS int)' for i in range(1, 5))} AS cls FROM orders, e)
    SELECT o_orderkey, (row_number() OVER (ORDER BY cls, {H.format('o_orderkey')}) - 1) % 5 AS fold FROM c""",
)
def interval_folds(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return rounded(folds.interval_folds(o, ["o_orderkey"], "o_totalprice", 5, 5).select("o_orderkey", "fold"))


@query(
    "C4",
    f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    c AS (SELECT o_orderkey, {' + '.join(f'cast(o_totalprice > lo + (hi - lo) * {i} / 5 AS int)' for i in range(1, 5))} AS cls,
        {' + '.join(f'cast(o_custkey % 10 > {i} * 9e0 / 5 AS int)' for i in range(1, 5))} AS cls2 FROM orders, e)
    SELECT o_orderkey, cast((row_number() OVER (ORDER BY cls, {H.format('o_orderkey')}) - 1) % 4 = 0 AS BIGINT) AS is_test_price,
    cast((row_number() OVER (ORDER BY cls2, {H.format('o_orderkey')}) - 1) % 4 = 0 AS BIGINT) AS is_test_cust FROM c""",
)
def interval_holdouts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 10).alias("cust"))
    out = folds.interval_holdouts(o, ["o_orderkey"], ["price", "cust"], 0.25)
    return rounded(out.select("o_orderkey", "is_test_price", "is_test_cust"))


@query(
    "C5",
    f"""SELECT o_orderkey, cast(rn <= round(n * 0.2e0) AS BIGINT) AS is_test FROM (SELECT o_orderkey,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format('o_orderkey')}) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def stratified_holdout(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return rounded(folds.stratified_holdout(o, ["o_orderkey"], "o_orderpriority", 0.2).select("o_orderkey", "is_test"))


@query("C6 J16 T3", None)
def spatial_folds(spark, d):
    return folds.spatial_folds(sites(spark, d), 5, key="c_custkey")


@query("C8", None)
def spatial_holdout(spark, d):
    return folds.spatial_holdout(sites(spark, d), 0.25, key="c_custkey")


@query(
    "C7 C10 T3",
    f"""WITH ranked AS (SELECT c_nationkey, row_number() OVER (ORDER BY n DESC, {H.format('c_nationkey')}) - 1 AS i FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1))
    SELECT c_custkey, cast(CASE WHEN (i // 4) % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END AS BIGINT) AS fold FROM customer JOIN ranked USING (c_nationkey)""",
)
def group_folds(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return rounded(folds.group_folds(c, "c_nationkey", 4).select("c_custkey", "fold"))


@query(
    "C11 E15",
    f"""WITH s AS (SELECT c_custkey, c_nationkey, 4.2e0 + (c_custkey * 7919 % 9600) / 1000e0 AS lat, 2.7e0 + (c_custkey * 104729 % 12000) / 1000e0 AS lon FROM customer),
    p AS (SELECT c_nationkey, arg_min(lat, h) AS y, arg_min(lon, h) AS x, count(*) AS n FROM (SELECT *, {H.format('c_custkey')} AS h FROM s) GROUP BY 1)
    SELECT c_custkey, cast(row_number() OVER (PARTITION BY s.c_nationkey ORDER BY 2 * 6371e0 * asin(sqrt(pow(sin((radians(y) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin((radians(x) - radians(lon)) / 2), 2))), c_custkey)
        > floor(n * 4 / 5) AS BIGINT) AS is_test FROM s JOIN p ON s.c_nationkey = p.c_nationkey""",
)
def nearest_to_centroid(spark, d):
    s = sites(spark, d)
    return rounded(folds.nearest_to_centroid(s, ["c_custkey"], "c_nationkey", 5).select("c_custkey", "is_test"))


@query("C12", "SELECT c_custkey, dense_rank() OVER (ORDER BY r_name) - 1 AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def leave_country_out(spark, d):
    c, n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rounded(folds.leave_one_group_out(j.select("c_custkey", "r_name"), "r_name").select("c_custkey", "fold"))


@query("T5", f"SELECT o_orderkey FROM orders ORDER BY {H.format('o_orderkey')} LIMIT 1000")
def sample_rows(spark, d):
    return folds.sample_rows(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 1000)


@query(
    "T5",
    f"""WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H.format('o_orderkey')}, o_orderkey) AS pos FROM orders),
    ids AS (SELECT row_number() OVER () - 1 AS i FROM orders),
    drawn AS (SELECT 1 + CAST('0x' || substr(md5(concat_ws('|', CAST(i AS VARCHAR), '43')), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS pos FROM ids)
    SELECT o_orderkey, count(*) AS draws FROM placed JOIN drawn USING (pos) GROUP BY 1""",
)
def bootstrap_counts(spark, d):
    """As many draws as there are orders, with replacement."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return folds.sample_with_replacement(o, ["o_orderkey"], o.count())


@query("T2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def head_by_order(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")
