"""Scalar-function, set, projection and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, rounded
from catalog.fixtures import table, v_survey, v_tower, with_views
from catalog.q_folds import TRUTH, truth
from terracell.functions import scalars as sc
from terracell.operators import columns as cols
from terracell.operators import joins
from terracell.operators.raster import clean_title
from terracell.plans import features as feat


@query(
    "F1 F3 P1",
    "SELECT c_custkey, lower(c_name) AS low, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS title, split_part(c_name, '#', -1) AS last, replace(c_name, '#', '_') AS safe, cast(contains(c_name, '7') AS BIGINT) AS has7 FROM customer",
)
def text_functions(spark, d):
    c = cols.lower_names(table(spark, d, "customer").withColumnRenamed("c_name", "C_NAME"))
    return rounded(
        c.select(
            "c_custkey",
            F.lower("c_name").alias("low"),
            F.initcap("c_mktsegment").alias("title"),
            F.element_at(F.split("c_name", "#"), -1).alias("last"),
            F.replace("c_name", F.lit("#"), F.lit("_")).alias("safe"),
            F.contains("c_name", F.lit("7")).alias("has7"),
        )
    )


@query("F2", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('img_' || p_brand || 'Data_nigeria_500.tif', '\\.tif$', ''), 'img|_|nigeria|500', '', 'g'), 'Data', '', 'g') AS title FROM part")
def raster_titles(spark, d):
    p = table(spark, d, "part").withColumn("t", F.concat(F.lit("img_"), "p_brand", F.lit("Data_nigeria_500.tif")))
    return p.select("p_partkey", clean_title(F.col("t"), r"img|_|nigeria|500").alias("title"))


@query("F4 A14", "SELECT p_partkey, 'x_' || replace(p_type, ' ', ',x_') AS prefixed FROM part")
def prefixed_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(sc.prefixed(F.split("p_type", " "), "x_"), ",").alias("prefixed"))


@query(
    "F5 F6 F7 F8",
    """SELECT o_orderkey, 'hexes_' || lower(o_orderstatus) || '_res7_thres' || (o_custkey % 40) AS name, strftime(make_date(year(o_orderdate), 3 * quarter(o_orderdate) - 2, 1), '%Y-%m-%d') AS quarter,
    'shapefiles/performance/type=mobile/year=' || year(o_orderdate) || '/quarter=' || quarter(o_orderdate) || '/' || strftime(make_date(year(o_orderdate), 3 * quarter(o_orderdate) - 2, 1), '%Y-%m-%d') || '_performance_mobile_tiles.zip' AS source,
    'housing' || (o_orderkey % 5) AS target FROM orders""",
)
def name_templates(spark, d):
    o = table(spark, d, "orders")
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    key = F.concat(F.lit("nigeria~res7~target-housing"), (F.col("o_orderkey") % 5).cast("string"), F.lit("~cv-normal"))
    return o.select(
        "o_orderkey",
        sc.dataset_name(F.lit("hexes"), "o_orderstatus", F.lit(7), F.col("o_custkey") % 40).alias("name"),
        sc.quarter_start(y, q).cast("string").alias("quarter"),
        sc.tile_source_name(F.lit("mobile"), y, q).alias("source"),
        sc.target_of_key(key).alias("target"),
    )


@query(
    "F10 F11 F12",
    """SELECT o_orderkey, round(greatest(least(o_totalprice / 197000, 1), 0), 6) AS clipped, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, 0)::BIGINT AS "GSM" FROM orders""",
)
def clip_and_zero_fill(spark, d):
    from terracell.operators.conformal import clip_unit

    o = table(spark, d, "orders").select(
        "o_orderkey",
        clip_unit(F.col("o_totalprice") / 197000, "dep_housing_sev").alias("clipped"),
        F.when(F.col("o_orderkey") % 3 == 0, 1).alias("GSM"),
    )
    return rounded(cols.zero_fill(o, ["GSM", "LTE"]))


@query("F14 M12", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END::BIGINT AS cls FROM orders")
def value_classes(spark, d):
    o = table(spark, d, "orders")
    return rounded(o.select("o_orderkey", cols.map_values(F.col("o_orderstatus"), {"F": 0, "O": 1}, 9).alias("cls")))


@query(
    "F15 S9",
    """SELECT c_custkey, '{"targeting_spec":{"geo_locations":{"custom_locations":[{"latitude":' || (c_custkey % 90) || ',"longitude":' || (c_custkey % 180) || ',"radius":' || (1 + c_custkey % 3) || ',"distance_unit":"kilometer"}]}},"optimization_goal":"REACH"}' AS request FROM customer""",
)
def audience_requests(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") % 90).alias("lat"), (F.col("c_custkey") % 180).alias("long")
    )
    return feat.audience_request(c, F.lit(1) + F.col("c_custkey") % 3).select("c_custkey", "request")


@query(
    "F16",
    """SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>')) AS r FROM pages
    UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>')) FROM pages) GROUP BY page_id""",
)
def html_table_rows(spark, d):
    """Table rows of every page, its list items read as one-cell rows too."""
    p = table(spark, d, "pages")
    as_rows = F.regexp_replace(F.regexp_replace("html", r"(?i)<li([^>]*)>", "<tr$1><td>"), r"(?i)</li>", "</td></tr>")
    rows = p.select("page_id", F.explode(sc.html_rows(as_rows)).alias("cells"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F20",
    "SELECT c_custkey, round((CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 90 + (c_custkey % 60) / 60e0 + (c_custkey % 59) / 3600e0), 6) AS deg FROM customer",
)
def dms_to_degrees(spark, d):
    k = F.col("c_custkey")
    hemi = F.when(k % 2 == 0, "S").otherwise("N")
    return rounded(table(spark, d, "customer").select(k, sc.dms_degrees(k % 90, k % 60, k % 59, hemi).alias("deg")))


@query(
    "J15 J14 A11",
    "SELECT code, coalesce(n_name, code) AS name, count(*) AS n FROM (SELECT cast(c_custkey % 30 AS VARCHAR) AS code FROM customer) LEFT JOIN nation ON cast(n_nationkey AS VARCHAR) = code GROUP BY 1, 2",
)
def decode_with_fallback(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 30).cast("string").alias("code"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return joins.decode(c, names, "code", "n_name", "name").groupBy("code", "name").agg(F.count(F.lit(1)).alias("n"))


@query("J18", "SELECT n_name, cast(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_name = 'NATION_7'")
def fuzzy_country(spark, d):
    return rounded(joins.fuzzy_country(table(spark, d, "nation"), "natoin_7", "n_name").select("n_name", "n_nationkey"))


@query(
    "J8 P16",
    with_views(
        ["v_survey"],
        "SELECT hex_code, a.n, round(b.truth, 6) AS truth FROM (SELECT hex_code, count(*) AS n FROM t WHERE country <> 'ASIA' GROUP BY 1) a FULL JOIN (SELECT hex_code, avg(truth) AS truth FROM t WHERE country <> 'AFRICA' GROUP BY 1) b USING (hex_code)",
        [TRUTH],
    ),
)
def outer_replace_targets(spark, d):
    t = truth(spark, d)
    a = t.filter("country <> 'ASIA'").groupBy("hex_code").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("truth"))
    b = t.filter("country <> 'AFRICA'").groupBy("hex_code").agg(F.avg("truth").alias("truth"))
    return rounded(joins.replace_targets(a, b, ["truth"]))


@query(
    "J12 J13 U3 U6",
    "SELECT o_orderkey, 'kept' AS side FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, 'left' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def semi_and_anti(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = joins.restrict_to(o, c, "o_custkey").select("o_orderkey", F.lit("kept").alias("side"))
    left = joins.missing_from(o, c, "o_custkey").select("o_orderkey", F.lit("left").alias("side"))
    return kept.unionByName(left)


@query(
    "U1 S15",
    "SELECT p_partkey AS k, p_size::BIGINT AS size, NULL::DOUBLE AS bal FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
)
def union_missing_columns(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return rounded(cols.union_all([a, b]))


@query("M8 A27", "SELECT o_orderstatus AS status, impute, scale, cv, n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (VALUES ('mean'), ('knn'), ('none')) a(impute), (VALUES ('standard'), ('robust')) b(scale), (VALUES ('normal'), ('spatial')) c(cv)")
def parameter_sweep(spark, d):
    from terracell.operators.models import parameter_sweep as sweep

    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    runs = sweep(spark, {"impute": ["mean", "knn", "none"], "scale": ["standard", "robust"], "cv": ["normal", "spatial"]})
    grid = runs.agg(F.collect_list(F.struct("impute", "scale", "cv")).alias("g")).scalar()
    return o.withColumn("g", grid).select("status", "n", F.explode("g").alias("r")).select("status", "r.*", "n")


@query("T6", "SELECT l_returnflag, arg_min(l_quantity, l_extendedprice) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def best_trial(spark, d):
    from terracell.operators.models import best_trial as best

    return best(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query(
    "M11",
    """SELECT l_partkey, l_suppkey, l_linenumber, cast(sum(CASE WHEN l_discount = 0 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount = 0.05 THEN 2 ELSE 3 END) AS DOUBLE) AS cls
    FROM (SELECT l_partkey, l_suppkey, cast(l_linenumber AS BIGINT) AS l_linenumber, l_discount FROM lineitem) GROUP BY 1, 2, 3""",
)
def inflated_classes(spark, d):
    from terracell.operators.twostage import plan_classes

    li = table(spark, d, "lineitem")
    plan = plan_classes(li, "l_discount", [0.0, 0.05])
    return rounded(li.withColumn("c", plan.label("l_discount")).groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.sum("c").alias("cls")))
