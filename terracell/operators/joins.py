"""Key joins that stand in for index-aligned and positional combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions.scalars import name_or_code


def replace_targets(dataset: DataFrame, expanded: DataFrame, targets: Sequence[str], key: str = "hex_code") -> DataFrame:
    """Full outer: targets come from the expanded table only, everything else from the dataset."""
    fresh = expanded.select(key, *targets)
    kept = dataset.drop(*targets)
    joined = kept.join(fresh, key, "outer")
    return joined.select(*[c for c in dataset.columns if c in joined.columns])


def restrict_to(df: DataFrame, keys: DataFrame, key: str = "hex_code") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def missing_from(df: DataFrame, keys: DataFrame, key: str = "hex_code") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def attach(df: DataFrame, *others: DataFrame, key: str = "hex_code") -> DataFrame:
    """Columns of tables side by side, by key and never by position."""
    out = df
    for o in others:
        out = out.join(o, key, "left")
    return out


def decode(df: DataFrame, names: DataFrame, code: str, name: str, output: str) -> DataFrame:
    """Code to name, falling back to the code itself."""
    joined = df.join(names.select(F.col(code), F.col(name).alias("_name")), code, "left")
    return joined.withColumn(output, name_or_code("_name", code)).drop("_name")


def fuzzy_country(countries: DataFrame, text: str, name: str = "name") -> DataFrame:
    """The country whose name is nearest to the text, as one row; a literal against one scan."""
    wanted = F.lit(text.strip().lower())
    low = F.lower(name)
    distance = F.struct(
        (~low.contains(wanted)).cast("int").alias("outside"), F.levenshtein(low, wanted).alias("d"), low.alias("n")
    )
    best = countries.agg(F.min_by(F.struct(*countries.columns), distance).alias("c"))
    return best.select("c.*")
