"""Registration of queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def query(ops: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name with the inventory rows it covers."""

    def add(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(fn, sql, ops)
        return fn

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits and counts to bigint, the common form of both engines."""
    def one(c: str, t: str) -> Column:
        if t in ("double", "float") or t.startswith("decimal"):
            # + 0.0 turns a negative zero into zero
            return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c)
        if t in ("int", "smallint", "tinyint", "boolean"):
            return F.col(c).cast("bigint").alias(c)
        return F.col(c)

    return df.select(*[one(c, t) for c, t in df.dtypes])
