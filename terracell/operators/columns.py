"""Projections, predicates and column-set operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.util import known

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def select_country(df: DataFrame, code: str, lat: str, long: str) -> DataFrame:
    """Rows of one padded country code that carry coordinates."""
    df = lower_names(df)
    return df.filter(F.trim("countrycode") == code).na.drop(subset=[lat, long])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    return df.select(*[known(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def k_or_more(df: DataFrame, ks: Sequence[int] = (2, 3, 4), total: str = "sumpoor_sev") -> DataFrame:
    """``dep_{k}_or_more_sev`` flags; a missing total is False, not missing."""
    return df.withColumns(
        {f"dep_{k}_or_more_sev": F.coalesce(F.col(total) >= k, F.lit(False)) for k in ks}
    )


def numeric_columns(df: DataFrame, with_bool: bool = False) -> list[str]:
    kinds = NUMERIC + (("boolean",) if with_bool else ())
    return [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]


def other_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def add_suffix(df: DataFrame, suffix: str, key: str | Sequence[str] = "hex_code") -> DataFrame:
    keep = {key} if isinstance(key, str) else set(key)
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keep})


def short_names(columns: Sequence[str]) -> dict[str, str]:
    """``dep_x_sev_mean -> x_prev`` and ``dep_x_sev_count -> x_count``; deprived_sev keeps its name."""
    out = {}
    for c in columns:
        m = re.fullmatch(r"(.*_sev)_(mean|count)", c)
        if m and m.group(1) != "deprived_sev":
            stem = m.group(1).replace("dep_", "").replace("_sev", "")
            out[c] = f"{stem}_{'prev' if m.group(2) == 'mean' else 'count'}"
    return out


def long_names(columns: Sequence[str]) -> dict[str, str]:
    """The way back from expanded names to dataset names.

    ``_mean`` is dropped and ``_prev`` becomes ``_sev``; names of that kind get the ``dep_`` mark
    again unless they are the total or the overall flag.
    """
    out = {}
    for c in columns:
        if c.endswith("_mean"):
            out[c] = c[: -len("_mean")]
        elif c.endswith("_prev"):
            stem = c[: -len("_prev")] + "_sev"
            out[c] = stem if stem.startswith(("sumpoor", "deprived", "dep_")) else "dep_" + stem
    return out


def rename_short(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(short_names(df.columns))


def rename_long(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(long_names(df.columns))


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*matching(df, pattern))


def features_before(df: DataFrame, marker: str = "survey") -> list[str]:
    return df.columns[: df.columns.index(marker)]


def from_marker(df: DataFrame, marker: str = "survey") -> list[str]:
    return df.columns[df.columns.index(marker) :]


def insert_before(df: DataFrame, block: Sequence[str], marker: str = "survey") -> DataFrame:
    """Columns reordered so that a block stands right before the marker."""
    rest = [c for c in df.columns if c not in block]
    at = rest.index(marker)
    return df.select(*rest[:at], *block, *rest[at:])


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def drop_encoder_columns(df: DataFrame) -> DataFrame:
    return drop_matching(df, r"auto_")


def replace_columns(df: DataFrame, other: DataFrame, on: str = "hex_code", how: str = "left") -> DataFrame:
    """Attach other's columns, replacing old ones of the same name."""
    overlap = [c for c in other.columns if c != on and c in df.columns]
    return df.drop(*overlap).join(other, on, how)


def excluding(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.filter(F.col(column) != name)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the input is empty; reads one row at most."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill({c: 0 for c in columns if c in df.columns})


def map_values(column: Column, mapping: Mapping, default) -> Column:
    """Value to class with a default."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
