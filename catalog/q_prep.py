"""Feature preparation and patch encoding queries."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import sql_axial, v_patch, v_survey, with_views
from catalog.q_folds import TRUTH, truth
from terracell.functions import grid
from terracell.operators import encode, folds, imputers, prep
from terracell.session import ensure_checkpoint_dir, spread

GAPS = """SELECT o_orderkey AS hex_code, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_custkey % 97 AS double) END AS cust, o_orderpriority AS prio, o_orderstatus AS status FROM orders"""


def gaps(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("hex_code"),
        F.when(k % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 7 != 0, (F.col("o_custkey") % 97).cast("double")).alias("cust"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "X1 X2",
    f"""SELECT hex_code, round(coalesce(price, (SELECT avg(price) FROM g)), 6) AS price, round(coalesce(cust, (SELECT avg(cust) FROM g)), 6) AS cust,
    CASE WHEN price IS NULL THEN 1e0 ELSE 0e0 END AS price_missing, CASE WHEN cust IS NULL THEN 1e0 ELSE 0e0 END AS cust_missing FROM ({GAPS}) g2""".replace(
        "FROM g)", f"FROM ({GAPS}) g)"
    ),
)
def impute_mean(spark, d):
    g = gaps(spark, d)
    lacking = prep.missing_columns(g, ["price", "cust"])
    return rounded(prep.fill(prep.add_indicators(g, lacking), prep.fit_fill(g, ["price", "cust"])).drop("prio", "status"))


@query(
    "X1",
    f"""SELECT hex_code, round(coalesce(price, (SELECT median(price) FROM ({GAPS}) g)), 6) AS price, coalesce(cust, (SELECT median(cust) FROM ({GAPS}) g)) AS cust FROM ({GAPS}) g2""",
)
def impute_median(spark, d):
    g = gaps(spark, d)
    return rounded(prep.fill(g, prep.fit_fill(g, ["price", "cust"], "median")).drop("prio", "status"))


@query("X6 F11", f"SELECT hex_code, coalesce(nullif(prio, '5-LOW'), 'Unknown') AS prio FROM ({GAPS})")
def impute_constant(spark, d):
    g = gaps(spark, d).withColumn("prio", F.nullif(F.col("prio"), F.lit("5-LOW")))
    return prep.fill_categories(g, ["prio"]).select("hex_code", "prio")


@query(
    "X7",
    f"""SELECT hex_code, round((price - a) / s, 6) AS standard, round((price - lo) / (hi - lo), 6) AS minmax, round((price - q2) / (q3 - q1), 6) AS robust FROM ({GAPS}),
    (SELECT avg(price) AS a, stddev_pop(price) AS s, min(price) AS lo, max(price) AS hi, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM ({GAPS}))""",
)
def scale_columns(spark, d):
    g = gaps(spark, d)
    out = g.select("hex_code", *[F.col("price").alias(k) for k in ("standard", "minmax", "robust")])
    scales = {k: prep.fit_scale(g, ["price"], k)["price"] for k in ("standard", "minmax", "robust")}
    return rounded(prep.scale(out, scales))


@query(
    "X8 X9 X10 X11 P14 F19",
    f"""SELECT hex_code, code, string_agg(hot, ',' ORDER BY i) AS hot FROM (SELECT hex_code, cast(dense_rank() OVER (ORDER BY status) - 1 AS double) AS code,
    cast(cast(prio = v AS int) AS VARCHAR) AS hot, i FROM ({GAPS}), (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT prio AS v FROM ({GAPS}))) ) GROUP BY 1, 2""",
)
def encode_categories(spark, d):
    g = gaps(spark, d)
    low, high = prep.card_split(g, ["prio", "status"], n=11)
    stages = [*prep.one_hot_stages(["prio"]), prep.ordinal_stage(["status"])]
    out = prep.pipeline(stages if low == ["prio", "status"] and not high else []).fit(g).transform(g)
    hot = F.array_join(F.transform(vector_to_array("prio_hot"), lambda v: v.cast("int").cast("string")), ",")
    return out.select("hex_code", F.col("status_code").alias("code"), hot.alias("hot"))


@query(
    "X12 F9",
    f"SELECT hex_code, round(CASE WHEN cust > 0 THEN ln(cust) END, 6) AS y, cast(cust <= 0 AS BIGINT) AS y_undefined FROM ({GAPS})",
)
def log_target(spark, d):
    return rounded(prep.log_target(gaps(spark, d), "cust", "y").select("hex_code", "y", "y_undefined"))


def power_sql() -> str:
    """Likelihood of each lambda on a grid that is refined twice around its best value; prices are positive."""
    base = f"g AS (SELECT hex_code, price / 1000 AS price FROM ({GAPS}) WHERE price IS NOT NULL), j AS (SELECT count(*) AS n, sum(ln(1 + price)) AS j FROM g), b0 AS (SELECT 0e0 AS best)"
    bent = "CASE WHEN abs(lam) < 1e-9 THEN ln(price + 1) ELSE (pow(price + 1, lam) - 1) / lam END"
    steps = []
    for i, (low, high, step) in enumerate([(-15, 25, "0.2e0"), (-10, 10, "(0.2e0 / 10)"), (-10, 10, "(0.2e0 / 10 / 10)")]):
        grid = f"SELECT best + i * {step} AS lam FROM b{i}, range({low}, {high + 1}) r(i)"
        steps.append(f"b{i + 1} AS (SELECT arg_max(lam, -n / 2 * ln(v) + (lam - 1) * j) AS best FROM (SELECT lam, var_pop({bent}) AS v FROM g, ({grid}) GROUP BY lam), j)")
    return f"""WITH {base}, {', '.join(steps)}, z AS (SELECT hex_code, price, {bent.replace('lam', 'best')} AS y FROM g, b3)
    SELECT hex_code, round(price, 6) AS price, round((y - (SELECT avg(y) FROM z)) / (SELECT stddev_pop(y) FROM z), 6) AS z, round(price, 6) AS back FROM z"""


@query("X13", power_sql())
def power_target(spark, d):
    g = gaps(spark, d).filter("price IS NOT NULL").withColumn("price", F.col("price") / 1000)
    p = prep.fit_power(g, "price")
    z = g.select("hex_code", "price", p.apply(F.col("price")).alias("z"))
    return rounded(z.withColumn("back", p.invert(F.col("z"))))


@query(
    "X21 F17",
    with_views(
        ["v_survey"],
        f"SELECT country, hex_code, cast({' + '.join(f'cast(truth > {i}e0 / 5 AS int)' for i in range(1, 5))} AS BIGINT) AS cls FROM t",
        [TRUTH],
    ),
)
def quintile_classes(spark, d):
    t = truth(spark, d)
    return rounded(t.select("country", "hex_code", folds.fixed_class("truth", [i / 5 for i in range(6)]).alias("cls")))


@query(
    "X14 G2 P15 P17 P18 P22",
    with_views(["v_survey"], "SELECT country, hex_code, round(pred, 6) AS pred FROM t", [TRUTH]),
)
def feature_columns(spark, d):
    from terracell.operators import columns as cols

    t = truth(spark, d).withColumn("survey", F.lit(1)).select("country", "hex_code", "pred", F.lit(0).alias("auto_1"), F.lit(1).alias("n_health"), "survey", "truth")
    names = cols.features_before(cols.require(t, ["hex_code"]), "survey")
    x = cols.drop_encoder_columns(cols.drop_present(t.select(*names), ["n_health", "n_education"]))
    return rounded(x)


@query(
    "X16",
    with_views(
        ["v_patch"],
        """SELECT hex_code, round(sum(abs((v - a) / CASE WHEN s = 0 THEN 1 ELSE s END)), 4) AS total FROM (SELECT *, avg(v) OVER (PARTITION BY i) AS a, stddev_pop(v) OVER (PARTITION BY i) AS s FROM (
        SELECT hex_code, unnest(pixels)::double AS v, unnest(range(len(pixels))) AS i FROM v_patch)) GROUP BY hex_code""",
    ),
)
def standardized_patches(spark, d):
    p = encode.standardize_patches(v_patch(spark, d))
    return p.select("hex_code", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


@query("X18 K6 J14", None)
def patch_encodings(spark, d):
    return rounded(encode.encode_patches(v_patch(spark, d), 8))


@query("X19 R13", None)
def triplet_encodings(spark, d):
    return rounded(encode.triplet_features(v_patch(spark, d), bands=4, size=16, k=3))


@query("X3", None)
def impute_knn(spark, d):
    g = gaps(spark, d).withColumn("when", F.pmod("hex_code", F.lit(365)).cast("double"))
    scaled = prep.scale(g, prep.fit_scale(g, ["price", "cust", "when"], "standard"))
    return rounded(imputers.filled_in_place(scaled, imputers.imputer("knn", ["price", "cust", "when"], [])).drop("prio", "status"))


@query("X4", None)
def impute_linear(spark, d):
    g = gaps(spark, d).withColumn("when", F.pmod("hex_code", F.lit(365)).cast("double"))
    return rounded(imputers.filled_in_place(g, imputers.imputer("linear", ["price", "cust", "when"], [])).drop("prio", "status"))


@query("X5", None)
def impute_forest(spark, d):
    g = gaps(spark, d).withColumn("when", F.pmod("hex_code", F.lit(365)).cast("double"))
    return rounded(imputers.filled_in_place(g, imputers.imputer("rf", ["price", "cust", "when"], [])).drop("prio", "status"))


def orders_with_gaps(spark, d):
    """Price in thousands, and a column without gaps."""
    g = gaps(spark, d).drop("prio", "status").withColumn("price", F.col("price") / 1000)
    return g.withColumn("day", F.pmod("hex_code", F.lit(365)).cast("double"))


GAP_ROWS = f"SELECT hex_code, price / 1000 AS price, cust, cast(hex_code % 365 AS double) AS day FROM ({GAPS})"


def saved_and_loaded(spark, d, stage, deal=lambda df: df):
    """All rows, filled by a pipeline that has learnt from four fifths of them, was saved and loaded."""
    g = orders_with_gaps(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/imputer-{uuid.uuid4().hex}"
    prep.pipeline([stage]).fit(g.filter("hex_code % 5 <> 0")).write().save(path)
    out = PipelineModel.load(path).transform(deal(g))
    return rounded(out.select("hex_code", F.col("price__x").alias("price"), F.col("cust__x").alias("cust"), F.col("cust_missing").alias("cust_missing")))


@query(
    "Z7 X4 X2 K13",
    f"""WITH g AS ({GAP_ROWS}), tr AS (SELECT * FROM g WHERE hex_code % 5 <> 0), m AS (SELECT avg(price) AS mp, avg(cust) AS mc FROM tr),
    s1 AS (SELECT regr_slope(price, coalesce(cust, mc)) AS b, regr_intercept(price, coalesce(cust, mc)) AS a FROM tr, m WHERE price IS NOT NULL),
    f1 AS (SELECT cust, coalesce(price, a + b * coalesce(cust, mc)) AS p FROM tr, m, s1),
    s2 AS (SELECT regr_slope(cust, p) AS b, regr_intercept(cust, p) AS a FROM f1 WHERE cust IS NOT NULL),
    p AS (SELECT hex_code, cust, coalesce(price, a + b * coalesce(cust, mc)) AS price FROM g, m, s1)
    SELECT hex_code, round(price, 6) AS price, round(coalesce(cust, a + b * price), 6) AS cust, cast(cust IS NULL AS double) AS cust_missing FROM p, s2""",
)
def saved_fill_linear(spark, d):
    return saved_and_loaded(spark, d, imputers.imputer("linear", ["price", "cust"], ["cust"], rounds=1, ridge=0.0))


@query(
    "Z7 X3 X2 K13",
    f"""WITH g AS ({GAP_ROWS}), tr AS (SELECT * FROM g WHERE hex_code % 5 <> 0), m AS (SELECT avg(price) AS mp, avg(cust) AS mc FROM tr),
    pairs AS (SELECT a.hex_code, a.price IS NULL AS ask_price, a.cust IS NULL AS ask_cust, b.price, b.cust,
        (coalesce((a.price - b.price) ** 2, 0) + coalesce((a.cust - b.cust) ** 2, 0) + (a.day - b.day) ** 2) * 3
        / (1 + cast(a.price IS NOT NULL AND b.price IS NOT NULL AS int) + cast(a.cust IS NOT NULL AND b.cust IS NOT NULL AS int)) AS dist
        FROM g a JOIN tr b ON a.hex_code <> b.hex_code WHERE a.price IS NULL OR a.cust IS NULL),
    p AS (SELECT hex_code, avg(price) AS v FROM (SELECT hex_code, price FROM pairs WHERE ask_price AND price IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY hex_code ORDER BY dist, price) <= 5) GROUP BY 1),
    c AS (SELECT hex_code, avg(cust) AS v FROM (SELECT hex_code, cust FROM pairs WHERE ask_cust AND cust IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY hex_code ORDER BY dist, cust) <= 5) GROUP BY 1)
    SELECT hex_code, round(coalesce(price, p.v, mp), 6) AS price, round(coalesce(cust, c.v, mc), 6) AS cust, cast(cust IS NULL AS double) AS cust_missing
    FROM g LEFT JOIN p USING (hex_code) LEFT JOIN c USING (hex_code), m""",
)
def saved_fill_neighbours(spark, d):
    return saved_and_loaded(spark, d, imputers.imputer("knn", ["price", "cust", "day"], ["cust"]))


@query("Z7 X5 X2 K13", None)
def saved_fill_forest(spark, d):
    return saved_and_loaded(spark, d, imputers.imputer("rf", ["price", "cust", "day"], ["cust"]), spread)


def survey_features(spark, d):
    s = v_survey(spark, d).filter("latnum IS NOT NULL").withColumn("hex_code", grid.cell_of("latnum", "longnum", 4))
    return s.groupBy("hex_code").agg(
        F.avg("latnum").alias("lat"),
        F.avg("longnum").alias("long"),
        F.avg("age").alias("age"),
        F.avg("dep_housing_sev").alias("housing"),
        F.avg("dep_water_sev").alias("water"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )


@query("X20", None)
def selected_features(spark, d):
    f = survey_features(spark, d)
    picked = prep.select_features(f, ["lat", "long", "age", "n"], "housing")
    rows = [(c, k) for k, names in picked.items() for c in names]
    return spark.createDataFrame(rows, "feature string, verdict string")
