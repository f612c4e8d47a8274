"""Text, date and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terracell.functions.util import as_col


def prefixed(values: Column | str, prefix: str) -> Column:
    return F.transform(as_col(values), lambda v: F.concat(F.lit(prefix), v))


def quarter_start(year: Column | str, quarter: Column | str) -> Column:
    """First day of a quarter; a quarter outside 1..4 raises."""
    y, q = as_col(year).cast("int"), as_col(quarter).cast("int")
    wrong = F.raise_error(F.lit("quarter must be within 1 and 4")).cast("date")
    return F.when(q.between(1, 4), F.make_date(y, (q * 3 - 2).cast("int"), F.lit(1))).otherwise(wrong)


def tile_source_name(service: Column | str, year: Column | str, quarter: Column | str) -> Column:
    """Relative name of a quarterly performance-tile file."""
    start = quarter_start(year, quarter)
    return F.format_string(
        "shapefiles/performance/type=%s/year=%d/quarter=%d/%s_performance_%s_tiles.zip",
        as_col(service),
        as_col(year).cast("int"),
        as_col(quarter).cast("int"),
        F.date_format(start, "yyyy-MM-dd"),
        as_col(service),
    )


def dataset_name(kind: Column | str, country: Column | str, res: Column | str, threshold: Column | str) -> Column:
    return F.format_string(
        "%s_%s_res%d_thres%d",
        as_col(kind),
        F.lower(as_col(country)),
        as_col(res).cast("int"),
        as_col(threshold).cast("int"),
    )


def target_of_key(key: Column | str) -> Column:
    """Target name inside a run key."""
    return F.regexp_extract(as_col(key), r"target-([^~]+)", 1)


def name_or_code(name: Column | str, code: Column | str) -> Column:
    return F.coalesce(as_col(name), as_col(code))


def dms_degrees(degrees: Column | str, minutes: Column | str, seconds: Column | str, hemisphere: Column | str) -> Column:
    size = as_col(degrees) + as_col(minutes) / F.lit(60.0) + as_col(seconds) / F.lit(3600.0)
    return F.when(as_col(hemisphere).isin("S", "W"), -size).otherwise(size)


def html_rows(html: Column | str) -> Column:
    """Cell texts of every table row: ``array<array<string>>``."""
    rows = F.regexp_extract_all(as_col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(
        rows,
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)),
            lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", "")),
        ),
    )
