"""Score, rank and validation queries over truth and prediction by (country, cell)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import sql_cell_lat, sql_cell_long, v_survey, v_zone, with_views
from catalog.q_folds import TRUTH, truth
from terracell.functions import grid
from terracell.operators import aggregates as agg
from terracell.operators import conformal
from terracell.operators import evaluate as ev

R2 = "1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*))"
WR2 = "1 - sum(weight * (truth - pred) * (truth - pred)) / (sum(weight * truth * truth) - sum(weight * truth) * sum(weight * truth) / sum(weight))"


@query(
    "V1 V2 V3 V4 Y5",
    with_views(
        ["v_survey"],
        f"""SELECT country, count(*) AS n, round({R2}, 6) AS r2, round(sqrt(avg((truth - pred) * (truth - pred))), 6) AS rmse,
        round(avg(abs(truth - pred)), 6) AS mae, round(1 - (1 - ({R2})) * (count(*) - 1) / (count(*) - 3 - 1), 6) AS adjusted_r2 FROM t GROUP BY country""",
        [TRUTH],
    ),
)
def scores_by_country(spark, d):
    return rounded(ev.score(truth(spark, d), "truth", "pred", ["country"], n_features=3))


def _scores(rows: str, where: str) -> str:
    return f"""SELECT '{rows}' AS "rows", round({R2}, 6) AS r2, round(sqrt(avg((truth - pred) * (truth - pred))), 6) AS rmse, round(avg(abs(truth - pred)), 6) AS mae,
        round({WR2}, 6) AS weighted_r2, round(sqrt(sum(weight * (truth - pred) * (truth - pred)) / sum(weight)), 6) AS weighted_rmse,
        round(sum(weight * abs(truth - pred)) / sum(weight), 6) AS weighted_mae FROM t WHERE {where}"""


@query(
    "V5 V6 P20",
    with_views(["v_survey"], _scores("all", "true") + " UNION ALL " + _scores("without ASIA", "country <> 'ASIA'"), [TRUTH]),
)
def weighted_scores(spark, d):
    return rounded(ev.score_with_without(truth(spark, d), "truth", "pred", "weight", "country", "ASIA"))


@query("V7", with_views(["v_survey"], "SELECT country, round(corr(truth, pred), 6) AS pearson FROM t GROUP BY country", [TRUTH]))
def pearson(spark, d):
    return rounded(ev.pearson(truth(spark, d), "truth", "pred", ["country"]))


@query(
    "V7 W5",
    with_views(
        ["v_survey"],
        """SELECT round(corr(rt, rp), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2e0 AS rt,
        rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2e0 AS rp FROM t)""",
        [TRUTH],
    ),
)
def spearman(spark, d):
    return rounded(ev.spearman(truth(spark, d), "truth", "pred"))


LAB = "SELECT doc_id, quality AS label, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)"


def label_pairs(spark, d):
    lab, doc = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    return lab.join(doc, "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("pred")
    )


@query("V8", f"SELECT cast(label AS BIGINT) AS label, cast(pred AS BIGINT) AS pred, count(*) AS n FROM ({LAB}) GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return rounded(ev.confusion(label_pairs(spark, d), "label", "pred"))


@query(
    "V8",
    f"""WITH x AS ({LAB}), c AS (SELECT DISTINCT label AS class FROM x UNION SELECT DISTINCT pred FROM x)
    SELECT cast(class AS BIGINT) AS class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
    round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1, support FROM (
    SELECT class, (SELECT count(*) FROM x WHERE label = class AND pred = class)::double AS hit, (SELECT count(*) FROM x WHERE pred = class) AS said,
    (SELECT count(*) FROM x WHERE label = class) AS support FROM c)""",
)
def class_report(spark, d):
    return rounded(ev.class_report(label_pairs(spark, d), "label", "pred"))


@query("V8", f"SELECT round(avg(CASE WHEN label = pred THEN 1e0 ELSE 0e0 END), 6) AS micro_f1 FROM ({LAB})")
def micro_f1(spark, d):
    return rounded(ev.micro_f1(label_pairs(spark, d), "label", "pred"))


AREA = f"""SELECT t.*, zone_id FROM (SELECT *, {sql_cell_lat('hex_code', 3)} AS lat, {sql_cell_long('hex_code', 3)} AS long FROM t) t
    JOIN v_zone ON long >= x0 AND long < x1 AND lat >= y0 AND lat < y1"""


@query(
    "V9 J11 W1 W2 A9",
    with_views(
        ["v_survey", "v_zone"],
        f"""SELECT cast(zone_id AS BIGINT) AS zone_id, cast(sum(weight) AS BIGINT) AS weight, round(avg(truth), 6) AS truth, round(sum(truth * share), 6) AS truth_pop_adj,
        round(avg(pred), 6) AS pred, round(sum(pred * share), 6) AS pred_pop_adj FROM (
        SELECT *, weight / sum(weight) OVER (PARTITION BY zone_id) AS share FROM ({AREA})) GROUP BY zone_id""",
        [TRUTH],
    ),
)
def area_validation(spark, d):
    t = truth(spark, d).withColumns({"lat": grid.cell_lat("hex_code", 3), "long": grid.cell_long("hex_code", 3)})
    return rounded(ev.area_validation(t, v_zone(spark, d), "zone_id", ["truth", "pred"], "weight"))


@query(
    "W1 W2",
    with_views(
        ["v_survey"],
        "SELECT country, hex_code, round(weight / sum(weight) OVER (PARTITION BY country), 6) AS share, round(pred * weight / sum(weight) OVER (PARTITION BY country), 6) AS pred_adj FROM t",
        [TRUTH],
    ),
)
def share_of_total(spark, d):
    s = agg.share_of_total(truth(spark, d), "weight", "country", "share")
    return rounded(s.select("country", "hex_code", "share", (F.col("pred") * F.col("share")).alias("pred_adj")))


@query(
    "V12 J14 A18",
    with_views(["v_survey"], "SELECT 'truth' AS \"column\", round(corr(truth, age), 6) AS corr FROM x UNION ALL SELECT 'pred', round(corr(pred, age), 6) FROM x", [
        ("x", f"""SELECT hex_code, avg(truth) AS truth, avg(pred) AS pred, min(weight) AS age FROM ({TRUTH[1]}) GROUP BY hex_code""")
    ]),
)
def compare_with_index(spark, d):
    cells = truth(spark, d).groupBy("hex_code").agg(F.avg("truth").alias("truth"), F.avg("pred").alias("pred"), F.min("weight").alias("age"))
    return rounded(ev.compare_with_index(cells.drop("age"), cells.select("hex_code", "age"), ["truth", "pred"], "age"))


@query(
    "V13 A27 W7 F9",
    with_views(["v_survey"], f"SELECT country, 'housing' AS target, round(greatest({R2}, 0), 6) AS r2 FROM t GROUP BY country", [TRUTH]),
)
def floored_country_means(spark, d):
    s = ev.score(truth(spark, d), "truth", "pred", ["country"]).withColumn("target", F.lit("housing"))
    return rounded(ev.country_means(s))


@query(
    "I1 I2 I4 F10 A25 P23",
    with_views(
        ["v_survey"],
        """SELECT country, hex_code, round(greatest(least(pred - w, 1), 0), 6) AS lower, round(pred, 6) AS prediction, round(greatest(least(pred + w, 1), 0), 6) AS upper FROM t,
        (SELECT a AS w FROM (SELECT abs(truth - pred) AS a, row_number() OVER (ORDER BY abs(truth - pred)) AS i FROM t)
        WHERE i = (SELECT least(ceil((count(*) + 1) * 0.9e0), count(*)) FROM t))""",
        [TRUTH],
    ),
)
def prediction_intervals(spark, d):
    t = truth(spark, d)
    out = conformal.predict_intervals(t, conformal.calibrate(t, "truth", "pred", alpha=0.1), "pred")
    return rounded(out.select("country", "hex_code", "lower", "prediction", "upper"))


@query(
    "I4 A25",
    with_views(
        ["v_survey"],
        """SELECT round(avg(u - l), 6) AS mean_width, round(min(u - l), 6) AS min_width, round(max(u - l), 6) AS max_width FROM (
        SELECT greatest(least(pred - w, 1), 0) AS l, greatest(least(pred + w, 1), 0) AS u FROM t,
        (SELECT a AS w FROM (SELECT abs(truth - pred) AS a, row_number() OVER (ORDER BY abs(truth - pred)) AS i FROM t)
        WHERE i = (SELECT least(ceil((count(*) + 1) * 0.95e0), count(*)) FROM t)))""",
        [TRUTH],
    ),
)
def interval_widths(spark, d):
    t = truth(spark, d)
    out = conformal.predict_intervals(t, conformal.calibrate(t, "truth", "pred"), "pred")
    return rounded(conformal.width_stats(out))
