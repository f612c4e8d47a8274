"""Train/test splits and folds as columns.

Order comes from a seeded md5 of the row key, so a split is repeatable on any cluster layout.
Row numbers use ``shuffled_position``: no window over the whole table or over a whole class.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.functions import geom
from terracell.functions.util import as_col, md5_order
from terracell.operators.ranking import shuffled_position, value_order_positions, value_positions
from terracell.session import cut_lineage


def interval_class(df: DataFrame, column: str, cuts: int, name: str = "cls") -> DataFrame:
    """Equal-width, right-closed class 0..cuts-1 over the column's range; null stays null."""
    ends = df.agg(
        F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("e")
    ).scalar()
    x, lo, hi = F.col(column).cast("double"), F.col("_e.lo"), F.col("_e.hi")
    inner = sum(
        ((x > lo + (hi - lo) * F.lit(i) / F.lit(cuts)).cast("int") for i in range(1, cuts)), F.lit(0)
    )
    cls = F.when(lo == hi, F.lit((cuts - 1) // 2)).otherwise(inner)
    return df.withColumn("_e", ends).withColumn(name, F.when(x.isNotNull(), cls)).drop("_e")


def fixed_class(x: Column | str, edges: Sequence[float], include_lowest: bool = True) -> Column:
    """Right-closed class by fixed edges; null outside them."""
    x = as_col(x)
    inner = sum(((x > F.lit(float(e))).cast("int") for e in edges[1:-1]), F.lit(0))
    low = x >= edges[0] if include_lowest else x > edges[0]
    return F.when(low & (x <= edges[-1]), inner)


def random_holdout(df: DataFrame, keys: Sequence[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for the first ceil(share * n) rows of the shuffle."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = shuffled_position(df, keys, seed=seed, name="_pos")
    return placed.withColumn("is_test", F.col("_pos") <= F.ceil(n * F.lit(share))).drop("_pos")


def random_folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    placed = shuffled_position(df, keys, seed=seed, name="_pos")
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")


def class_folds(df: DataFrame, keys: Sequence[str], cls: str, k: int, seed: int = 42) -> DataFrame:
    """Round robin over the rows sorted by class: each class is spread evenly and the next class
    goes on where the last one stopped."""
    placed = shuffled_position(df, keys, by=[cls], seed=seed, name="_pos")
    # One row per class: the window below ranges over the classes, not over the data.
    earlier = Window.partitionBy(F.lit(1)).orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(cls).alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    joined = placed.join(starts, F.col(cls).eqNullSafe(F.col("_c")))
    turn = F.col("_pos") - 1 + F.col("_start")
    return joined.withColumn("fold", (turn % k).cast("int")).drop("_pos", "_c", "_start")


def interval_folds(
    df: DataFrame, keys: Sequence[str], target: str, k: int = 5, cuts: int = 5, seed: int = 42, check: bool = False
) -> DataFrame:
    """Interval-stratified folds. ``check`` compares the class sizes with k first."""
    classed = interval_class(df, target, cuts, "_cls")
    if check:
        check_class_sizes(classed, "_cls", k, cuts)
    return class_folds(classed, keys, "_cls", k, seed).drop("_cls")


def check_class_sizes(df: DataFrame, cls: str, k: int, cuts: int) -> None:
    sizes = {r[cls]: r["n"] for r in df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(cuts)]
    if all(c < k for c in counts):
        raise ValueError(f"n_splits={k} exceeds the size of every class")
    if min(counts) < k:
        warnings.warn(f"smallest class has {min(counts)} rows, fewer than {k} folds", stacklevel=2)


def interval_holdouts(
    df: DataFrame, keys: Sequence[str], targets: Sequence[str], share: float = 0.2, cuts: int = 5, seed: int = 42
) -> DataFrame:
    """One ``is_test_<target>`` column per target: fold 0 of int(1/share) stratified folds."""
    out = df
    for t in targets:
        folded = interval_folds(df.select(*keys, t), keys, t, int(1 / share), cuts, seed)
        out = out.join(folded.select(*keys, (F.col("fold") == 0).alias(f"is_test_{t}")), list(keys))
    return out


def stratified_holdout(df: DataFrame, keys: Sequence[str], cls: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    placed = shuffled_position(df, keys, by=[cls], seed=seed, name="_pos")
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(cls, "_c")
    joined = placed.join(sizes, F.col(cls).eqNullSafe(F.col("_c")))
    return joined.withColumn("is_test", F.col("_pos") <= F.round(F.col("_n") * F.lit(share))).drop("_pos", "_n", "_c")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups to folds, dealt by falling size to and fro over the folds.

    Groups of equal size come in a seeded shuffle. One rule for any number of groups: sizes are
    counted, ranked in ranges and joined back, nothing is collected. Fold sizes differ by the
    largest group at most.
    """
    sizes = cut_lineage(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), (-F.count(F.lit(1))).alias("_less")))
    n_groups = sizes.count()
    if k > n_groups:
        raise ValueError(f"{k} folds but only {n_groups} groups")
    equal = shuffled_position(sizes, [group], by=["_n"], name="_at")
    larger = value_positions(sizes, "_less").select((-F.col("_less")).cast("long").alias("_n"), "below")
    ranked = equal.join(larger, "_n").withColumn("_rank", F.col("below") + F.col("_at") - 1)
    turn, at = F.floor(F.col("_rank") / k), F.pmod("_rank", F.lit(k))
    fold = F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold")
    return df.join(ranked.select(F.col(group).alias("_group"), fold), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _nearest(centres: Sequence[tuple[float, float]], open_: Sequence[int], lat: str, long: str) -> Column:
    """Struct (km, centre) of the nearest open centre: a least over literals, no join."""
    return F.array_min(
        F.array(
            *[
                F.struct(
                    geom.haversine_km(lat, long, F.lit(float(centres[i][0])), F.lit(float(centres[i][1]))).alias("km"),
                    F.lit(i).alias("centre"),
                )
                for i in open_
            ]
        )
    )


def _near_in_plane(centres: Sequence[tuple[float, float]], lat: str, long: str) -> Column:
    """Struct (d2, centre) of the centre at the least squared distance in degrees."""
    each = []
    for i, (y, x) in enumerate(centres):
        dy, dx = F.col(lat) - F.lit(y), F.col(long) - F.lit(x)
        each.append(F.struct((dy * dy + dx * dx).alias("d2"), F.lit(i).alias("centre")))
    return F.array_min(F.array(*each))


def even_centres(
    points: DataFrame, k: int, seed: int, key: str, lat: str = "lat", long: str = "long", rounds: int = 20
) -> list[tuple[float, float]]:
    """k-means centres that are the same for every partitioning; none without points.

    The start is the first row of the shuffle, then each time the row farthest from all picked ones (ties by the
    shuffle). Means come from decimal sums, which no order of rows changes. A round sends k rows to the driver.
    """
    located = points.filter(F.col(lat).isNotNull() & F.col(long).isNotNull())
    order = md5_order(key, seed=seed)
    place = F.struct(F.col(lat).cast("double").alias("y"), F.col(long).cast("double").alias("x"))
    first = located.agg(F.min_by(place, F.struct(order, place)).alias("at")).first()["at"]
    if first is None:
        return []
    centres = [(first["y"], first["x"])]
    while len(centres) < k:
        far = F.struct(_near_in_plane(centres, lat, long)["d2"], order, place)
        at = located.agg(F.max_by(place, far).alias("at")).first()["at"]
        centres.append((at["y"], at["x"]))
    for _ in range(rounds):
        mine = located.groupBy(_near_in_plane(centres, lat, long)["centre"].alias("centre"))
        sums = mine.agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(20,9)")).alias(n) for c, n in ((lat, "y"), (long, "x"))]
        ).collect()
        moved = dict(enumerate(centres)) | {r["centre"]: (float(r["y"] / r["n"]), float(r["x"] / r["n"])) for r in sums}
        after = [moved[i] for i in range(k)]
        if after == centres:
            break
        centres = after
    return centres


def spatial_groups(
    df: DataFrame, k: int = 5, seed: int = 42, key: str = "hex_code", lat: str = "lat", long: str = "long"
) -> DataFrame:
    """Compact groups of at most ceil(n/k) rows around k-means centres.

    Bounded rounds: every unplaced row bids for its nearest open centre, and a centre with more
    bids than room keeps its closest. Each round fills a centre or places the rest, so there are
    at most k rounds; each ends in a reliable checkpoint. Groups do not change with the partitioning.
    Without any coordinates the group is null.
    """
    rest = cut_lineage(df.select(key, lat, long))
    centres = even_centres(rest, k, seed, key, lat, long)
    if not centres:
        return df.withColumn("group", F.lit(None).cast("int"))
    n = rest.count()
    room = {i: -(-n // k) for i in range(len(centres))}
    placed: list[DataFrame] = []
    while True:
        open_ = [i for i, r in room.items() if r > 0]
        bids = rest.withColumn("_b", _nearest(centres, open_, lat, long)).select(
            key, lat, long, F.col("_b.km").alias("_km"), F.col("_b.centre").alias("group")
        )
        wanted = {r["group"]: r["n"] for r in bids.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(n_bids <= room[i] for i, n_bids in wanted.items()):
            placed.append(bids.select(key, "group"))
            break
        ranked = value_order_positions(bids, "_km", key, ["group"], "_pos")
        limit = F.element_at(
            F.create_map(*[F.lit(v) for i in open_ for v in (i, room[i])]), F.col("group")
        )
        decided = cut_lineage(ranked.withColumn("_in", F.col("_pos") <= limit))
        placed.append(decided.filter("_in").select(key, "group"))
        rest = decided.filter("NOT _in").select(key, lat, long)
        for i, n_bids in wanted.items():
            room[i] -= min(room[i], n_bids)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return df.join(out, key)


def spatial_folds(df: DataFrame, k: int = 5, seed: int = 42, **names: str) -> DataFrame:
    """Spatial groups, then groups to folds (one group per fold)."""
    return spatial_groups(df, k, seed, **names).withColumnRenamed("group", "fold")


def spatial_holdout(df: DataFrame, share: float = 0.2, seed: int = 42, **names: str) -> DataFrame:
    folded = spatial_folds(df, int(1 / share), seed, **names)
    return folded.withColumn("is_test", F.col("fold") == 0).drop("fold")


def cv_folds(
    df: DataFrame,
    mode: str = "normal",
    k: int = 5,
    target: str | None = None,
    seed: int = 42,
    cuts: int = 5,
    keys: Sequence[str] = ("hex_code",),
) -> DataFrame:
    """Fold column by mode: normal, stratified or spatial."""
    if mode == "normal":
        return random_folds(df, keys, k, seed)
    if mode == "stratified":
        if target is None or target not in df.columns:
            raise ValueError("stratified folds need a target column")
        return interval_folds(df, keys, target, k, cuts, seed)
    if mode == "spatial":
        return spatial_folds(df, k, seed, key=keys[0])
    raise ValueError(f"unknown fold mode: {mode}")


def nearest_to_centroid(
    df: DataFrame, keys: Sequence[str], by: str, k: int, seed: int = 42, lat: str = "lat", long: str = "long"
) -> DataFrame:
    """Per group, the (k-1)/k rows nearest to a randomly picked row train, the rest test."""
    picked = df.groupBy(by).agg(
        F.min_by(F.struct(F.col(lat).alias("y"), F.col(long).alias("x")), md5_order(*keys, seed=seed)).alias("_p"),
        F.count(F.lit(1)).alias("_n"),
    )
    far = df.join(picked, by).withColumn("_km", geom.haversine_km(lat, long, F.col("_p.y"), F.col("_p.x")))
    ranked = value_order_positions(far, "_km", keys[0], [by], "_pos")
    return ranked.withColumn("is_test", F.col("_pos") > F.floor(F.col("_n") * (k - 1) / k)).drop(
        "_p", "_n", "_km", "_pos"
    )


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Fold number per distinct group in name order, from the distinct groups alone."""
    names = df.select(group).distinct()
    numbered = names.withColumn("fold", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(group)) - 1)
    return df.join(numbered, group)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the first of the shuffle."""
    return shuffled_position(df, keys, seed=seed, name="_pos").filter(F.col("_pos") <= n).drop("_pos")


def sample_with_replacement(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, name: str = "draws") -> DataFrame:
    """Exactly ``n`` draws: each row that is drawn, with the number of times. An empty table gives no rows.

    A draw's md5 names a position of the shuffle, so the outcome does not depend on the partitioning. Draws are
    counted per position before they meet the rows.
    """
    total = F.nullif(df.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0))
    at = F.conv(F.substring(md5_order("id", seed=seed + 1), 1, 15), 16, 10).cast("bigint")
    draws = df.sparkSession.range(n).groupBy((F.pmod(at, total) + 1).alias("_pos")).agg(F.count(F.lit(1)).alias(name))
    return shuffled_position(df, keys, seed=seed, name="_pos").join(draws, "_pos").drop("_pos")
