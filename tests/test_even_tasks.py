"""No task holds one raster, collection or side of a join."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from catalog import q_prep
from terracell.functions import grid
from terracell.operators import imagery, imputers, raster, spatial
from terracell.plans import features

META = "raster string, crs string, a double, b double, c double, d double, e double, f double, width long, height long, nodata double, n_bands long"


@contextlib.contextmanager
def shuffled(spark, **more):
    """Joins as on large tables: none is broadcast, and partitions stay as they were dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"} | more
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def pixels(spark, n=4000):
    return spark.range(n).select(
        F.format_string("r%d", F.signum(F.col("id") + 1).cast("int")).alias("raster"), F.floor(F.col("id") / 50).alias("row"), (F.col("id") % 50).alias("col"), (F.col("id") % 7).cast("double").alias("b1")
    )


def metadata(spark):
    return spark.createDataFrame([("r1", "EPSG:4326", 0.1, 0.0, 1.0, 0.0, -0.1, 9.0, 50, 80, 3.0, 1)], META).repartition(2)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_masked_pixels_of_one_raster_are_many_tasks(spark):
    with shuffled(spark):
        out = raster.mask_nodata(pixels(spark), metadata(spark), ["b1"])
        assert out.columns == ["raster", "row", "col", "b1"]
        assert out.count() == 4000 and out.filter("b1 IS NULL").count() == pixels(spark).filter("b1 = 3").count()
        assert largest(out) < 2000


def test_wide_and_stored_pixels_of_one_raster_are_many_tasks(spark):
    with shuffled(spark):
        long = raster.to_long(raster.mask_nodata(pixels(spark), metadata(spark), ["b1"]), ["b1"])
        assert largest(long) < 2000
        assert raster.to_wide(long, ["b1"]).count() == pixels(spark).filter("b1 <> 3").count()


def test_located_pixels_and_windows_of_one_raster_are_many_tasks(spark):
    with shuffled(spark):
        at = raster.locate(pixels(spark), metadata(spark))
        assert at.columns == ["raster", "row", "col", "b1", "long", "lat"]
        assert largest(at) < 2000
        one = at.filter("row = 3 AND col = 4").first()
        assert (one["long"], one["lat"]) == pytest.approx((1.45, 8.65))


def test_slopes_of_one_raster_are_many_tasks(spark):
    with shuffled(spark):
        out = raster.slope_degrees(pixels(spark), metadata(spark), "b1")
        assert out.count() == 4000 and out.filter("slope IS NOT NULL").count() == 78 * 48
        assert largest(out) < 2000


def test_newest_image_of_one_collection_is_many_tasks(spark):
    images = pixels(spark).select(
        F.lit("c").alias("collection"), F.lit("q").alias("band"), F.when(F.col("row") < 78, F.lit(None)).otherwise(F.col("row")).alias("ts"), "row", "col", F.col("b1").alias("value")
    )
    undated = images.withColumn("ts", F.lit(None).cast("long"))
    with shuffled(spark):
        assert imagery.latest_image(images).count() == 50
        out = imagery.latest_image(undated)
        assert out.count() == 4000
        # the join before the aggregate: rows of the collection are dealt by place
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64(row" in plan and "LeftSemi" in plan


def test_resampling_broadcasts_no_pixels(spark):
    with shuffled(spark, **{"spark.sql.autoBroadcastJoinThreshold": "10485760"}):
        out, _ = raster.resample(pixels(spark), metadata(spark), 2.0, ["b1"])
        assert out.count() == 4 * 4000
        plan = out._jdf.queryExecution().sparkPlan().toString()
        large = plan[: plan.index("SortMergeJoin")]
        assert "BroadcastHashJoin" not in large


def test_pixels_of_one_file_are_grouped_in_many_tasks(spark):
    with shuffled(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "true"}):
        out = raster.to_wide(raster.to_long(pixels(spark).coalesce(1), ["b1"]), ["b1"])
        assert out.count() == 4000 and largest(out) < 2000


BOXES = "id, 2 + id % 60 / 10.0 AS minx, 3 + id % 50 / 10.0 AS miny, 4 + id % 60 / 10.0 AS maxx, 5 + id % 50 / 10.0 AS maxy"


def test_boxes_of_one_file_meet_areas_in_many_tasks(spark):
    ring = "POLYGON ((2 3, 9 3, 9 8, 2 8, 2 3))"
    areas = spark.createDataFrame([(1, ring)], "k int, geometry string").coalesce(1)
    with shuffled(spark, **{"spark.sql.autoBroadcastJoinThreshold": "10485760", "spark.sql.adaptive.coalescePartitions.enabled": "true"}):
        boxes = spark.range(3000).coalesce(1).selectExpr(*BOXES.split(", "))
        out = spatial.boxes_meeting_areas(boxes, areas, "k")
        assert out.count() == 3000 and largest(out) < 1500


def test_tiles_of_one_file_meet_cells_in_many_tasks(spark):
    tiles = spark.range(3000).coalesce(1).selectExpr(*BOXES.split(", "), "1.0 AS v").withColumns({"maxx": F.col("minx") + 0.05, "maxy": F.col("miny") + 0.05})
    cells = tiles.select(grid.cell_of("miny", "minx", 4).alias("hex_code")).distinct()
    out = features.areal_interpolation(cells, tiles, 4, "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 8, true") == 2  # cells and tiles
    assert out.filter("v = 1").count() == cells.count()


def with_gaps(spark, n=400):
    a = (F.col("id") % 50) / 10
    return spark.range(n).coalesce(1).select(
        F.col("id").alias("hex_code"), F.when(F.col("id") % 7 != 0, a).alias("a"), F.when(F.col("id") % 5 != 0, 2 * a + 1).alias("b")
    )


@pytest.mark.parametrize(("most", "tasks"), [(50, 8), (399, 2), (400, 1)])
def test_forests_of_one_large_file_are_fitted_in_many_tasks(spark, monkeypatch, most, tasks):
    monkeypatch.setattr(imputers, "ROWS_A_TASK", most, raising=False)
    seen, step = [], imputers.ChainImputer.step

    def watched(self, target):
        est = step(self, target)
        fit = est.fit
        est.fit = lambda known: seen.append((known.rdd.getNumPartitions(), largest(known))) or fit(known)
        return est

    monkeypatch.setattr(imputers.ChainImputer, "step", watched)
    df = with_gaps(spark)
    got = [imputers.imputer("rf", ["a", "b"], [], rounds=2).fit(df).transform(df).collect() for _ in range(2)]
    assert len(seen) == 8 and all(n == tasks and rows <= 400 / tasks + 1 for n, rows in seen)
    assert sorted(got[0]) == sorted(got[1])  # reruns draw the same rows
    off = [abs(r["b__x"] - 2 * r["a"] - 1) for r in got[0] if r["a"] is not None and r["b"] is None]
    assert off and sum(off) / len(off) < 0.8
    assert all(r["a"] is None or r["a__x"] == r["a"] for r in got[0])


def test_rows_of_one_file_are_filled_by_forests_in_many_tasks(spark):
    df = with_gaps(spark)
    with shuffled(spark):
        out = imputers.filled_in_place(df, imputers.imputer("rf", ["a", "b"], [], rounds=1))
        assert out.columns == df.columns and out.filter("a IS NULL OR b IS NULL").count() == 0
        assert out.count() == 400 and largest(out) < 100


def test_a_saved_forest_fills_rows_of_one_file_in_many_tasks(spark, monkeypatch, tmp_path):
    orders = spark.range(400).coalesce(1).selectExpr("id AS o_orderkey", "id % 60 AS o_custkey", "'O' AS o_orderstatus", "id * 10.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    made = imputers.imputer
    monkeypatch.setattr(imputers, "imputer", lambda *a: made(*a, rounds=1, trees=2))
    with shuffled(spark):
        out = q_prep.saved_fill_forest(spark, str(tmp_path))
        assert out.count() == 400 and out.filter("price IS NULL OR cust IS NULL").count() == 0
        assert out.filter("cust_missing = 1").count() == 58 and largest(out) < 100
