"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def known(value: Column | str) -> Column:
    """NaN as null: null is the only marker for a missing number."""
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def md5_order(*keys: Column | str, seed: int = 42) -> Column:
    """Deterministic shuffled order key, the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", *[as_col(k).cast("string") for k in keys], F.lit(str(seed))))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
