"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. One scan yields length and prefix hash of each normalised text (both cost less than another
   scan). They are counted in one pre-aggregated shuffle of narrow rows.
2. The (length, prefix) groups of two or more rows are marked in a bitmap of ``filter_bits`` bits.
   Its size does not depend on the data, so it may be broadcast. Only rows whose bit is set get a
   full hash; a row marked by chance costs one hash and changes nothing. The texts of all other
   rows are never hashed in full, and no text is shuffled to find this out.
3. Marked rows are counted by full hash, pre-aggregated. Groups of two or more are joined back by a
   sort-merge join whose two sides are dealt out by the hash, so that the planner can split the
   partition of a hot group; rows outside the marked ones pass without a shuffle.

Defined results: a null text counts as empty and all empty texts are one group; of equal texts the
row with the most code points stays, then the smallest id, null ids last. Where the row that stays has
no id, ``keep_id`` is null for the whole group. Rows of one group that share id and number of code
points are copies of one document and get equal results; ``drop_copies`` leaves one of them. Extra
columns pass through, columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import fresh, replace_columns, stored, whole, without_spaces

RESULTS = ["keep_id", "group_size", "kept"]


def normalised(text: Column) -> Column:
    return without_spaces(text)


def bitmap_of(slots: DataFrame) -> DataFrame:
    """(part, bits): the set bits of the long column ``slot``, 32,768 to a row."""
    return slots.groupBy(F.shiftright("slot", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("bits")
    )


def bit_set(bits: Column, slot: Column) -> Column:
    at = slot.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(7) + 1)
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def exact_dedup(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix: int = 128, filter_bits: int = 23
) -> DataFrame:
    """``df`` with keep_id, group_size (long) and kept, one row per row of ``df``."""
    df = replace_columns(df, RESULTS)
    full, slot, points, mark = (fresh(df, c) for c in ("full_hash", "slot", "points", "marked"))
    norm = normalised(whole(text_col))
    key = F.xxhash64(F.length(norm), F.xxhash64(F.left(norm, F.lit(prefix))))
    keyed = df.withColumn(slot, F.pmod(key, F.lit(1 << filter_bits)))

    pairs = df.select(F.length(norm).alias("n"), F.xxhash64(F.left(norm, F.lit(prefix))).alias("p"))
    several = pairs.groupBy("n", "p").count().where("count > 1")
    bits = bitmap_of(
        several.select(F.pmod(F.xxhash64("n", "p"), F.lit(1 << filter_bits)).alias("slot"))
    )
    part, held = fresh(df, "part"), fresh(df, "bits")
    bits = stored(bits).select(F.col("part").alias(part), F.col("bits").alias(held))
    # at most 2**(filter_bits - 15) rows of 4 KiB
    marked = keyed.withColumn(part, F.shiftright(slot, 15)).join(F.broadcast(bits), part, "left")
    marked = marked.withColumn(mark, bit_set(F.col(held), F.col(slot))).drop(part, held, slot)
    hashed = marked.where(F.col(mark)).withColumn(full, F.unhex(F.sha2(norm, 256)))

    groups = (
        hashed.select(F.col(full).alias("f"), F.col(id_col).alias("id"), F.length(whole(text_col)).alias("c"))
        .groupBy("f", "c")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .groupBy("f")
        .agg(F.max_by("id", "c").alias("keep_id"), F.sum("n").alias("group_size"), F.max("c").alias(points))
        .where("group_size > 1")
    )
    groups = stored(groups).withColumnRenamed("f", full)
    alone = marked.where(~F.col(mark)).select(
        *df.columns,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    met = hashed.withColumn(fresh(df, "length"), F.length(whole(text_col)))
    met = met.join(groups, full, "left")
    # a group's keep_id may be null itself, so only its size tells whether there is a group
    grouped = F.col("group_size").isNotNull()
    stays = F.col("keep_id").eqNullSafe(F.col(id_col)) & (F.col(points) == F.col(fresh(df, "length")))
    met = met.select(
        *df.columns,
        F.when(grouped, F.col("keep_id")).otherwise(F.col(id_col)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, stays).otherwise(True).alias("kept"),
    )
    return alone.unionByName(met)


def drop_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, one of each group, with the columns of ``df``."""
    out = exact_dedup(df, text_col, id_col).where("kept")
    alone = out.where("group_size = 1").select(*df.columns)
    digest = fresh(out, "digest")
    kept = out.where("group_size > 1").withColumn(digest, F.sha2(normalised(whole(text_col)), 256))
    return alone.unionByName(kept.dropDuplicates([id_col, digest]).select(*df.columns))
