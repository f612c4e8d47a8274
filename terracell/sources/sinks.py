"""Writers, materialisation and the run table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell import schema as s
from terracell.functions import geom


def write_dataset(df: DataFrame, root: str, country: str, res: int, threshold: int, fmt: str = "parquet") -> None:
    """One partition folder per (country, res, threshold), replaced as a whole."""
    tagged = df.withColumns(
        {"country": F.lit(country.lower()), "res": F.lit(res), "threshold": F.lit(threshold)}
    )
    writer = (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("country", "res", "threshold")
    )
    writer.option("header", True).format(fmt).save(root)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def write_raster(pixels: DataFrame, meta: DataFrame, root: str) -> None:
    write_table(pixels, f"{root}/pixels", partition=("raster", "band"))
    write_table(meta, f"{root}/meta")


def write_tiles(df: DataFrame, path: str, columns: tuple[str, ...] = ("avg_d_kbps", "avg_u_kbps", "geometry")) -> None:
    write_table(df.select(*columns), path)


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def materialize(
    spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The stored table if it was completed, else build and write it first.

    Reading back also cuts the lineage at a shared, durable place.
    """
    path = f"{root}/{name}"
    if force or not _done(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def run_rows(
    spark: SparkSession,
    run_id: str,
    params: Mapping[str, object] | None = None,
    metrics: Mapping[str, float] | None = None,
    tags: Mapping[str, object] | None = None,
    artifacts: tuple[str, ...] = (),
) -> DataFrame:
    rows = [(run_id, "param", k, str(v), None) for k, v in (params or {}).items()]
    rows += [(run_id, "tag", k, str(v), None) for k, v in (tags or {}).items()]
    rows += [(run_id, "metric", k, None, float(v)) for k, v in (metrics or {}).items()]
    rows += [(run_id, "artifact", a, None, None) for a in artifacts]
    return spark.createDataFrame(rows, s.METRICS)


def score_rows(scores: DataFrame, run_id: str, target: str) -> DataFrame:
    """A one-row score table as metric rows."""
    names = [c for c in ("r2", "rmse", "mae") if c in scores.columns]
    return (
        scores.select(*names)
        .unpivot([], names, "key", "value")
        .select(
            F.lit(run_id).alias("run_id"),
            F.lit("metric").alias("kind"),
            F.concat_ws("_", F.lit(target), "key").alias("key"),
            F.lit(None).cast("string").alias("text"),
            F.col("value").cast("double").alias("value"),
        )
    )


def log_run(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def fetch_run(table: DataFrame, run_id: str, system_prefix: str = "system.") -> dict[str, DataFrame]:
    """Params, metrics, tags without system ones, and artifact names of a run."""
    mine = table.filter(F.col("run_id") == run_id)

    def of(kind: str) -> DataFrame:
        return mine.filter(F.col("kind") == kind)

    return {
        "params": of("param").select("key", "text"),
        "metrics": of("metric").select("key", "value"),
        "tags": of("tag").filter(~F.col("key").startswith(system_prefix)).select("key", "text"),
        "artifacts": of("artifact").select("key"),
    }


def best_params(table: DataFrame, prefix: str) -> DataFrame:
    """Parameters of the best run (highest mean r2) whose id starts with a prefix."""
    runs = table.filter(F.col("run_id").startswith(prefix))
    r2 = runs.filter((F.col("kind") == "metric") & F.col("key").endswith("r2"))
    best = r2.groupBy("run_id").agg(F.avg("value").alias("r2")).agg(F.max_by("run_id", "r2").alias("run_id"))
    return runs.filter(F.col("kind") == "param").join(best, "run_id").select("key", "text")


def earlier_best(table: DataFrame, prefix: str) -> dict[str, list[str]]:
    """``best_params`` on the driver, a row a parameter; a run saved again gives each value that it has had."""
    out: dict[str, list[str]] = {}
    for r in best_params(table, prefix).distinct().orderBy("key", "text").collect():
        out.setdefault(r["key"], []).append(r["text"])
    return out


def write_geojson(df: DataFrame, parts: str, properties: Sequence[str], by: str, path: str) -> None:
    """One feature collection per value of ``by``, in a folder of its own; properties are written as text."""
    about = F.to_json(F.create_map(*[x for c in properties for x in (F.lit(c), F.col(c).cast("string"))]))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), about, F.lit(',"geometry":'), geom.geojson_geometry(parts), F.lit("}")
    )
    docs = df.groupBy(by).agg(F.sort_array(F.collect_list(feature)).alias("_all"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", "_all"), F.lit("]}"))
    docs.select(by, text.alias("value")).write.mode("overwrite").partitionBy(by).text(path)
