"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.session import cut_lineage, ensure_checkpoint_dir

#: One character of white space; the complement makes words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")
#: Size of the batches that whole texts go to Python in (both sides hold buffers of up to twice that), and its setting.
BATCH_BYTES = 4 * 2**20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether the files of an action's shuffles go when it ends.
FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    """All white space removed by byte search, which is cheaper than a pattern."""
    for c in SPACES:
        text = F.replace(text, F.lit(c))
    return text


def in_small_batches(spark: SparkSession) -> None:
    """Lets Python stages of this session have batches of ``BATCH_BYTES`` and one row, unless the session has its own size.

    Spark's default, 64 MB and 10,000 rows, is a whole task's texts in one batch.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions in here, such as stored and written steps, drop their shuffle files when they end.

    Else these stay until the driver happens to collect its garbage, and the steps' files add up. The session's
    own setting is back afterwards.
    """
    own = spark.conf.getAll.get(FREE_SETTING)
    spark.conf.set(FREE_SETTING, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(FREE_SETTING)
        else:
            spark.conf.set(FREE_SETTING, own)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint whose columns carry no partitioning.

    Joins then deal out both sides, and the planner can split the large partitions of hot keys.
    """
    cut = cut_lineage(df)
    return cut.select(*[F.when(F.lit(True), F.col(c)).alias(c) for c in cut.columns])


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to write."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written below the shared checkpoint folder and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
