"""Incremental landing of new files: a file stream run until everything present is taken in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def land_new_files(
    spark: SparkSession,
    source: str,
    kind: T.StructType,
    target: str,
    checkpoint: str,
    fmt: str = "csv",
    options: dict[str, str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    partition: tuple[str, ...] = (),
    max_files: int | None = None,
) -> None:
    """Append the files not taken in before to a Parquet table, each exactly once.

    The checkpoint remembers the files; a repeated call with nothing new writes nothing.
    """
    reader = spark.readStream.schema(kind).format(fmt).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(source)
    writer = (prepare(rows) if prepare else rows).writeStream.format("parquet").outputMode("append")
    if partition:
        writer = writer.partitionBy(*partition)
    query = writer.option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    query.awaitTermination()
