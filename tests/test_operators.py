import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from terracell.functions import grid
from terracell.operators import aggregates as agg
from terracell.operators import columns as cols
from terracell.operators import conformal, encode, folds, imputers, joins, prep, ranking, twostage
from terracell.operators import evaluate as ev
from terracell.operators import raster as ras


def test_flags_treat_missing_as_no(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,), (4.0,)], "sumpoor_sev double")
    got = [tuple(r)[1:] for r in cols.k_or_more(df).collect()]
    assert got == [(False,) * 3, (False,) * 3, (False,) * 3, (True, False, False), (True, True, True)]


def test_names_there_and_back():
    assert cols.short_names(["dep_water_sev_mean", "deprived_sev_mean", "sumpoor_sev_count", "dep_2_or_more_sev_mean"]) == {
        "dep_water_sev_mean": "water_prev",
        "sumpoor_sev_count": "sumpoor_count",
        "dep_2_or_more_sev_mean": "2_or_more_prev",
    }
    assert cols.long_names(["water_prev", "sumpoor_prev", "age_mean", "deprived_sev_mean"]) == {
        "water_prev": "dep_water_sev",
        "sumpoor_prev": "sumpoor_sev",
        "age_mean": "age",
        "deprived_sev_mean": "deprived_sev",
    }


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3)], "hex_code int, x double, survey string, y int")
    assert cols.features_before(df, "survey") == ["hex_code", "x"]
    assert cols.insert_before(df, ["y"], "survey").columns == ["hex_code", "x", "y", "survey"]
    assert cols.add_suffix(df, "_c").columns == ["hex_code", "x_c", "survey_c", "y_c"]
    with pytest.raises(ValueError):
        cols.require(df, ["nope"])
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert cols.nan_to_null(nan).filter("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        cols.require_rows(df.filter("x > 5"), "empty")


def test_spread_counts_shared_cells_once_per_answer(spark):
    cell = spark.range(1).select(grid.cell_of(F.lit(9.0), F.lit(8.0), 5).alias("c")).first()["c"]
    df = spark.createDataFrame([(cell, 1, 1.0), (cell, 2, 0.0), (cell, None, None)], "hex_code long, location int, a_sev double")
    out = agg.spread_to_neighbours(df)
    rows = {r["hex_code"]: r for r in out.collect()}
    assert len(rows) == 19
    assert rows[cell]["a_sev_mean"] == 0.5 and rows[cell]["a_sev_count"] == 2
    assert sum(r["a_sev_count"] == 2 for r in rows.values()) == 7


def test_null_policy_of_rasters(spark):
    px = spark.createDataFrame(
        [("r", "b1", 0, 0, 1.0), ("r", "b2", 0, 0, None), ("r", "b1", 0, 1, None), ("r", "b2", 0, 1, None)],
        "raster string, band string, row long, col long, value double",
    )
    assert ras.to_wide(px, ["b1", "b2"]).count() == 0
    assert ras.to_wide(px, ["b1", "b2"], null_policy="per_band").count() == 1


def _meta(spark, w, h):
    return spark.createDataFrame(
        [("r", "EPSG:4326", 1.0, 0.0, 0.0, 0.0, -1.0, float(h), w, h, None, 1)],
        "raster string, crs string, a double, b double, c double, d double, e double, f double, width long, height long, nodata double, n_bands long",
    )


def test_resample_by_one_is_identity_and_windows_pad(spark):
    px = spark.createDataFrame([("r", i, j, float(i * 5 + j)) for i in range(4) for j in range(5)], "raster string, row long, col long, v double")
    meta = _meta(spark, 5, 4)
    same, _ = ras.resample(px, meta, 1.0, ["v"])
    assert same.select("row", "col", "v").exceptAll(px.select("row", "col", "v")).count() == 0 and same.count() == 20
    pt = spark.createDataFrame([(1, 3.5, 0.5)], "hex_code int, lat double, long double")
    w = {(r["i"], r["j"]): r["v"] for r in ras.windows_at(pt, px, meta, ["r"], ["v"], 4, 4).collect()}
    assert len(w) == 16 and w[(0, 0)] == 0.0 and w[(2, 2)] == 0.0 and w[(2, 3)] == 1.0 and w[(3, 2)] == 5.0


def test_unknown_crs_and_band_names_refused(spark):
    px = spark.createDataFrame([("r", 0, 0, 1.0)], "raster string, row long, col long, v double")
    bad = _meta(spark, 1, 1).withColumn("crs", F.lit("EPSG:2154"))
    with pytest.raises(Exception, match="unsupported"):
        ras.locate(px, bad).collect()
    meta = _meta(spark, 1, 1).withColumn("title", F.lit("img_x.tif"))
    assert ras.band_names(meta, given=["one"], title="title").first()["band"] == "one"
    with pytest.raises(Exception, match="band names"):
        ras.band_names(meta, given=["one", "two"], title="title").collect()
    with pytest.raises(Exception, match="too many"):
        ras.refuse_wide(meta, 0).collect()


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_positions_match_a_plain_window(spark, hot):
    rng = random.Random(2)
    rows = [(i, i % 3, 7.0 if rng.random() < hot else rng.uniform(0, 10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    for by in ([], ["g"]):
        got = ranking.value_order_positions(df, "v", "k", by).collect()
        groups = {}
        for r in got:
            groups.setdefault(tuple(r[c] for c in by), []).append((r["position"], r["v"]))
        for g in groups.values():
            g.sort()
            assert [p for p, _ in g] == list(range(1, len(g) + 1))
            assert [v for _, v in g] == sorted(v for _, v in g)
        pos = ranking.value_positions(df, "v", by).collect()
        assert sum(p["ties"] for p in pos) == 2000
    ranked = ranking.average_rank(df, "v", "r").toPandas()
    assert np.allclose(ranked["r"], ranked["v"].rank())


def test_quantile_matches_numpy(spark):
    rng = random.Random(4)
    vals = [rng.gauss(0, 1) for _ in range(501)] + [0.0] * 200
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for q in (0.05, 0.25, 0.5, 0.9):
        assert agg.quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(vals, q))
    two = df.select("v", (F.col("v") * 100 + 5).alias("w"), F.lit(None).cast("double").alias("none"))
    got = ranking.column_quantiles(two, ["v", "w", "none"], [0.25, 0.9])
    assert got["v"] == pytest.approx(list(np.quantile(vals, [0.25, 0.9])))
    assert got["w"] == pytest.approx(list(np.quantile(np.array(vals) * 100 + 5, [0.25, 0.9])))
    assert got["none"] == [None, None]


def test_folds_are_whole_and_even(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), (F.col("id") % 100 / 100).alias("y"))
    for out in (folds.random_folds(df, ["k"], 5), folds.interval_folds(df, ["k"], "y", 5, 4)):
        sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
        assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    groups = folds.group_folds(df, "g", 3)
    assert groups.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        folds.group_folds(df, "g", 8)
    with pytest.raises(ValueError):
        folds.cv_folds(df, "other", keys=["k"])


def test_groups_of_any_number_are_dealt_alike(spark):
    for n in (7, 300, 5000):
        df = spark.range(n * 3).select(F.col("id").alias("k"), F.floor(F.sqrt(F.col("id"))).alias("g"))
        out = folds.group_folds(df, "g", 3)
        assert out.count() == n * 3
        assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
        sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
        largest = df.groupBy("g").count().agg(F.max("count")).first()[0]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= largest


def test_spatial_groups_do_not_change_with_the_partitioning(spark):
    df = spark.range(90).select(
        F.col("id").alias("hex_code"), (F.col("id") * 37 % 53 / 7.0).alias("lat"), (F.col("id") * 61 % 47 / 9.0).alias("long")
    )
    got = [
        {r["hex_code"]: r["group"] for r in folds.spatial_groups(d, 3).collect()} for d in (df.coalesce(1), df.repartition(7))
    ]
    assert got[0] == got[1] and sorted(got[0]) == list(range(90))
    lost = spark.createDataFrame([(1, None, None)], "hex_code long, lat double, long double")
    assert [r["group"] for r in folds.spatial_groups(lost, 3).collect()] == [None]


def test_draws_with_replacement(spark):
    df = spark.range(40).select((F.col("id") * 3).alias("k"), F.lit("x").alias("id"))
    one = {r["k"]: r["draws"] for r in folds.sample_with_replacement(df, ["k"], 500).collect()}
    assert sum(one.values()) == 500 and set(one) <= {3 * i for i in range(40)} and max(one.values()) > 1
    other = folds.sample_with_replacement(df.repartition(7), ["k"], 500).collect()
    assert {r["k"]: r["draws"] for r in other} == one
    assert folds.sample_with_replacement(df.filter("k < 0"), ["k"], 5).count() == 0
    assert folds.sample_with_replacement(df, ["k"], 0).count() == 0


def test_spatial_groups_are_balanced_even_when_points_pile_up(spark):
    rng = random.Random(0)
    rows = [(i, 5 + rng.random() * (0.01 if i % 3 == 0 else 5), 5 + rng.random() * (0.01 if i % 3 == 0 else 5)) for i in range(301)]
    df = spark.createDataFrame(rows, "hex_code long, lat double, long double")
    out = folds.spatial_groups(df, 4)
    sizes = [r["count"] for r in out.groupBy("group").count().collect()]
    assert sum(sizes) == 301 and max(sizes) <= 76


def test_interval_class_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.200001,), (1.0,), (None,)], "y double")
    assert [r["cls"] for r in folds.interval_class(df, "y", 5).collect()] == [0, 0, 1, 4, None]
    flat = spark.createDataFrame([(1.0,), (1.0,)], "y double")
    assert {r["cls"] for r in folds.interval_class(flat, "y", 5).collect()} == {2}


@pytest.mark.parametrize(
    "inflated,labels,points",
    [([0], [0, 0, 1, 1, 1], [0]), ([0, 1], [0, 0, 1, 1, 2], [0, 2]), ([0.5], [0, 0, 0, 1, 2], [1])],
)
def test_class_labels(spark, inflated, labels, points):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.2,), (0.5,), (1.0,)], "y double")
    plan = twostage.plan_classes(df, "y", inflated)
    assert [r["c"] for r in df.select(plan.label("y").alias("c")).collect()] == labels
    assert plan.point_classes == points


def test_two_stage_beats_the_mean(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, abs(b) + a if a > 0 else 0.0))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "k long, a double, b double, y double")
    )
    m = twostage.fit_two_stage(df, "y", RandomForestClassifier(seed=1), RandomForestRegressor(seed=1))
    for weighted in (False, True):
        s = ev.score(m.predict(df, weighted=weighted), "y", "prediction").first()
        assert s["n"] == 600 and s["r2"] > 0.5
    with pytest.raises(ValueError):
        twostage.plan_classes(df, "y", [0, 0])
    with pytest.raises(ValueError):
        twostage.fit_two_stage(df.filter("y = 0"), "y", RandomForestClassifier(), RandomForestRegressor())


def test_conformal_rank_and_coverage(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 20)], "t double, p double")
    width = conformal.calibrate(df, "t", "p", alpha=0.1)
    assert width.first()["width"] == 18.0
    out = conformal.predict_intervals(df, width, "p", target="sumpoor_sev")
    assert conformal.coverage(out, "t").first()[0] >= 0.9
    with pytest.raises(TypeError):
        conformal.require_fitted(object())


def test_scores(spark):
    flat = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5)], "t double, p double")
    assert ev.score(flat, "t", "p").first()["r2"] is None
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (4.0, None)], "t double, p double")
    s = ev.score(df, "t", "p").first()
    assert s["n"] == 2 and s["mae"] == 0.25 and s["r2"] == pytest.approx(0.5)


def test_outer_replace(spark):
    a = spark.createDataFrame([(1, 10, 0.1), (2, 20, 0.2)], "hex_code int, x int, t_sev double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "hex_code int, t_sev double")
    got = {r["hex_code"]: (r["x"], r["t_sev"]) for r in joins.replace_targets(a, b, ["t_sev"]).collect()}
    assert got == {1: (10, None), 2: (20, 0.9), 3: (None, 0.8)}


def filled(df, names, block):
    near = prep.knn_values(df, df, names, k=5, block_rows=block)
    means = prep.fit_fill(df, names)
    out = df.join(near, "hex_code", "left")
    return out.select("hex_code", *[F.coalesce(c, f"_f_{c}", F.lit(means[c])).alias(c) for c in names])


def test_knn_fill_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, *[None if rng.random() < 0.15 else rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "hex_code long, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    means = np.nanmean(x, axis=0)
    for block in (30, 5000):
        got = {r["hex_code"]: [r[c] for c in names] for r in filled(df, names, block).collect()}
        for i in range(len(x)):
            for j in range(4):
                if not np.isnan(x[i, j]):
                    assert got[i][j] == x[i, j]
                    continue
                dist = []
                for o in range(len(x)):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                    if o != i and both.any() and not np.isnan(x[o, j]):
                        dist.append((((x[i] - x[o])[both] ** 2).sum() * 4 / both.sum(), x[o, j]))
                dist.sort()
                want = np.mean([v for _, v in dist[:5]]) if dist else means[j]
                assert got[i][j] == pytest.approx(want)


def test_iterative_fill_recovers_a_line(spark):
    rng = random.Random(3)
    rows = [(i, float(i % 50), None if i % 9 == 0 else 2.0 * (i % 50) + rng.gauss(0, 0.01)) for i in range(400)]
    df = spark.createDataFrame(rows, "hex_code long, a double, b double")
    out = imputers.filled_in_place(df, imputers.imputer("linear", ["a", "b"], [], rounds=3))
    assert out.filter(F.abs(F.col("b") - 2 * F.col("a")) > 0.5).count() == 0


def test_power_target_inverts_and_evens_out(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.lognormvariate(0, 1),) for _ in range(500)], "y double")
    p = prep.fit_power(df, "y")
    z = df.select("y", p.apply(F.col("y")).alias("z")).withColumn("b", p.invert(F.col("z")))
    assert z.filter(F.abs(F.col("b") - F.col("y")) > 1e-6).count() == 0
    s = z.agg(F.skewness("z").alias("s"), F.avg("z").alias("m"), F.stddev_pop("z").alias("d")).first()
    assert abs(s["s"]) < 0.3 and abs(s["m"]) < 1e-9 and abs(s["d"] - 1) < 1e-9


def test_feature_selection_finds_the_signal(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, 3 * a + rng.gauss(0, 0.05)))
    df = spark.createDataFrame(rows, "hex_code long, a double, b double, y double")
    picked = prep.select_features(df, ["a", "b"], "y", n_trials=9)
    assert picked["accepted"] == ["a"] and "b" not in picked["accepted"]


def test_patches(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [3.0, 2.0])], "hex_code int, pixels array<double>")
    filled = {r["hex_code"]: r["pixels"] for r in encode.fill_patches(df).collect()}
    assert filled[1] == [1.0, -2.0]
    seq = spark.createDataFrame([(1, [float(i) for i in range(8)])], "k int, p array<double>")
    assert seq.select(encode.channels_last(F.col("p"), 2, 2, 2).alias("q")).first()["q"] == [0, 4, 1, 5, 2, 6, 3, 7]
    rng = random.Random(0)
    many = spark.createDataFrame([(i, [rng.random() for _ in range(16)]) for i in range(50)], "hex_code int, pixels array<double>")
    assert len(encode.triplet_features(many, 4, 4, 2).columns) == 1 + 2 * 2
    assert encode.encode_patches(many, 3).columns == ["hex_code", "f_0", "f_1", "f_2"]
