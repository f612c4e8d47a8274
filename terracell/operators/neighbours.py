"""Exact nearest rows over few columns, by boxes of donors.

Donors that have the same columns (``have``) are one group for each set of columns (``share``) that some incomplete
rows share with them: in a group the distance is Euclidean but for a factor. A group is cut into boxes at quantiles
of its shared columns. A row first meets the box it lies in; its k-th distance there says which other boxes may hold
a nearer donor, and only these it meets, too. Only counts and bounds of the boxes, whose number is limited, pass
through the driver; rows are dealt to the tasks by box, and a crowded box is split on either side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.session import cut_lineage

MOST_BOXES = 16384
MOST_GROUPS = 256
MOST_SLICES = 512
MOST_ASKS = 50_000
MOST_PAIRS = 2_000_000


@dataclass
class Group:
    """Donors that have ``have`` columns, cut along the ``share`` ones."""

    have: tuple[int, ...]
    share: tuple[int, ...]
    cuts: list  # cut points of each shared column
    first: object = None  # first box of each slot of the lattice, -1 without donors
    subs: object = None  # boxes of each slot
    box: object = None  # number of each box
    size: object = None  # donors of each box
    low: object = None
    high: object = None

    @property
    def wanted(self) -> list[int]:
        return [j for j in self.have if j not in self.share]

    @property
    def slots(self) -> int:
        out = 1
        for c in self.cuts:
            out *= len(c) + 1
        return out

    def slot(self, x):
        import numpy as np

        at = np.zeros(len(x), dtype=np.int64)
        for i, c in zip(self.share, self.cuts):
            at = at * (len(c) + 1) + np.searchsorted(c, x[:, i], side="right")
        return at

    def squares(self, x, names: int, which=slice(None)):
        """Least distances of rows to boxes."""
        import numpy as np

        out = np.zeros((len(x), len(self.box[which])))
        for d, i in enumerate(self.share):
            v = x[:, i][:, None]
            out += np.maximum(np.maximum(self.low[which][:, d] - v, v - self.high[which][:, d]), 0.0) ** 2
        return out * names / len(self.share)


def with_shape(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Key, values as doubles (NaN is missing), which are there, and a hash of it all."""
    values = df.select(F.col(key).alias("_key"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(names)])
    v = [F.col(f"_v{i}") for i in range(len(names))]
    return values.withColumns(
        {"_have": F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in v]), "_hash": F.pmod(F.xxhash64("_key", *v), F.lit(1 << 40))}
    )


def bits(text: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(text) if c == "1")


def groups_of(asks: DataFrame, donors: DataFrame, names: int, box_rows: int) -> list[Group] | None:
    """The groups and their cut points; none where there are too many."""
    import numpy as np

    lacking = [bits(r["_have"]) for r in asks.select("_have").distinct().limit(MOST_GROUPS + 1).collect()]
    counts = {bits(r["_have"]): r["n"] for r in donors.groupBy("_have").agg(F.count(F.lit(1)).alias("n")).limit(MOST_GROUPS + 1).collect()}
    pairs = {(q, tuple(i for i in q if i in p)) for p in lacking for q in counts}
    pairs = sorted((q, s) for q, s in pairs if s and s != q)
    if max(len(pairs), len(lacking), len(counts)) > MOST_GROUPS:
        return None
    rows = max(box_rows, -(-sum(counts[q] for q, _ in pairs) // MOST_BOXES))
    steps = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    used = ["".join("1" if i in q else "0" for i in range(names)) for q in {q for q, _ in pairs}]
    quantiles = {}
    if used:
        picks = [F.percentile_approx(f"_v{i}", steps, 4 * MOST_SLICES).alias(f"_v{i}") for i in range(names)]
        quantiles = {bits(r["_have"]): r for r in donors.filter(F.col("_have").isin(used)).groupBy("_have").agg(*picks).collect()}
    out = []
    for q, s in pairs:
        left, cuts = max(1, counts[q] // rows), []
        for d, i in enumerate(s):
            slices = max(1, min(MOST_SLICES, int(left ** (1 / (len(s) - d)) + 1e-9)))
            q_at = quantiles[q][f"_v{i}"]
            cuts.append(np.unique([q_at[round(t * MOST_SLICES / slices) - 1] for t in range(1, slices)]).astype(float))
            left = max(1, left // (len(cuts[-1]) + 1))
        out.append(Group(q, s, cuts))
    return out


def bounded(groups: list[Group], donors: DataFrame, names: int, box_rows: int) -> None:
    """Counts and bounds of the boxes of all groups."""
    import numpy as np
    import pyarrow as pa

    schema = "_g int, _slot long, " + ", ".join(f"_v{i} double" for i in range(names))

    def slotted(batches):
        for batch in batches:
            x, have = values_of(batch, names), batch.column("_have").to_pylist()
            for g, rows in members(groups, have):
                y = x[rows]
                cols = {"_g": np.full(len(rows), g, dtype=np.int32), "_slot": groups[g].slot(y)} | {f"_v{i}": y[:, i] for i in range(names)}
                yield pa.RecordBatch.from_pydict(cols)

    stats = donors.mapInArrow(slotted, schema).groupBy("_g", "_slot").agg(
        F.count(F.lit(1)).alias("n"), *[f(f"_v{i}").alias(f"{p}{i}") for i in range(names) for p, f in (("lo", F.min), ("hi", F.max))]
    ).collect()
    most = 4 * max(box_rows, -(-sum(r["n"] for r in stats) // MOST_BOXES))
    boxes = 0
    for g, group in enumerate(groups):
        found = sorted((r for r in stats if r["_g"] == g), key=lambda r: r["_slot"])
        group.first, group.subs = np.full(group.slots, -1, dtype=np.int64), np.ones(group.slots, dtype=np.int64)
        size, low, high, start = [], [], [], boxes
        for r in found:
            subs = -(-r["n"] // most)
            group.first[r["_slot"]], group.subs[r["_slot"]] = boxes, subs
            boxes += subs
            size += [r["n"] / subs] * subs
            low += [[r[f"lo{i}"] for i in group.share]] * subs
            high += [[r[f"hi{i}"] for i in group.share]] * subs
        group.box, group.size, group.low, group.high = np.arange(start, boxes), np.array(size), np.array(low), np.array(high)


def values_of(batch, names: int):
    import numpy as np

    return np.column_stack([batch.column(f"_v{i}").to_pandas().to_numpy(dtype=float) for i in range(names)])


def members(groups: list[Group], have: list[str], asking: bool = False):
    """(group, row numbers) for rows that give to it, or ask of it."""
    import numpy as np
    import pandas as pd

    codes, kinds = pd.factorize(np.array(have, dtype=object))
    for code, kind in enumerate(kinds):
        own, rows = bits(kind), np.flatnonzero(codes == code)
        for g, group in enumerate(groups):
            if (tuple(i for i in group.have if i in own) == group.share) if asking else (own == group.have):
                yield g, rows


def nearest(asks: DataFrame, donors: DataFrame, names: Sequence[str], key: str, k: int, box_rows: int) -> DataFrame | None:
    """``(key, col, dist, value)``: k nearest donors in each group and box that an incomplete row meets; none for too many groups."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, kind = len(names), dict(asks.dtypes)[key]
    asks, donors = with_shape(asks, key, names), with_shape(donors, key, names)
    groups = groups_of(asks, donors, n, box_rows)
    if groups is None:
        return None
    bounded(groups, donors, n, box_rows)
    owner = np.concatenate([np.full(len(g.box), i) for i, g in enumerate(groups)]) if groups else np.zeros(0, dtype=int)
    coords = ", ".join(f"_v{i} double" for i in range(n))
    routed = f"_box long, _key {kind}, _hash long, {coords}"
    met_schema = f"{routed}, col int, dist double, value double"

    def taken(batch, rows, box):
        at = pa.array(rows)
        cols = {"_box": pa.array(box, type=pa.int64())} | {c: pc.take(batch.column(c), at) for c in ("_key", "_hash", *[f"_v{i}" for i in range(n)])}
        return pa.RecordBatch.from_pydict(cols)

    def given(batches):
        for batch in batches:
            x, have, h = values_of(batch, n), batch.column("_have").to_pylist(), batch.column("_hash").to_numpy()
            for g, rows in members(groups, have):
                slot = groups[g].slot(x[rows])
                yield taken(batch, rows, groups[g].first[slot] + h[rows] % groups[g].subs[slot])

    def sent_home(batches):
        for batch in batches:
            x, have, h = values_of(batch, n), batch.column("_have").to_pylist(), batch.column("_hash").to_numpy()
            for g, rows in members(groups, have, asking=True):
                group = groups[g]
                slot = group.slot(x[rows])
                home = group.first[slot]
                box = home + h[rows] % group.subs[slot]
                large = group.size >= min(2 * k, group.size.max())
                lost = np.flatnonzero((home < 0) | ~large[np.maximum(home, group.box[0]) - group.box[0]])
                for part in np.array_split(lost, 1 + len(lost) * len(group.box) // MOST_PAIRS):
                    near = group.squares(x[rows[part]], n)
                    near[:, ~large] = np.inf
                    box[part] = group.box[near.argmin(axis=1)]
                yield taken(batch, rows, box)

    def best(left: pa.Table, right: pa.Table, forward: bool) -> pa.Table:
        out = {c: [] for c in ("_row", "col", "dist", "value", "_box")}

        def add(row, col, dist, value, box):
            for c, v in zip(out, (row, col, dist, value, box)):
                out[c].append(v)

        if left.num_rows and right.num_rows:
            home = left.column("_box")[0].as_py()
            group = groups[owner[home]]
            a, b = values_of(left, n), values_of(right, n)
            both = pa.chunked_array(left.column("_key").chunks + right.column("_key").chunks).combine_chunks()
            code = pc.fill_null(pc.index_in(both, value_set=pc.drop_null(pc.unique(both))), -1).to_numpy()
            own, other = code[: len(a)].copy(), code[len(a) :]
            own[own < 0] = -2  # a null key is no one's own
            share = list(group.share)
            for j in group.wanted:
                pick = condensed(b[:, share], other, b[:, j], k)
                c, cv, ck = b[pick], b[pick, j], other[pick]
                for rows in np.array_split(np.arange(len(a)), 1 + len(a) * len(c) // MOST_PAIRS):
                    x = a[rows]
                    d = distances(x, c, len(share))
                    d[own[rows][:, None] == ck[None, :]] = np.inf
                    limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(c) >= k else np.full(len(rows), np.inf)
                    r, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                    order = np.lexsort((at, d[r, at], r))  # donors stand in the order of their values
                    r, at = r[order], at[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
                    r, at = r[rank < k], at[rank < k]
                    add(rows[r], np.full(len(r), j), d[r, at], cv[at], np.full(len(r), -1))
                    if forward and j == group.wanted[0]:
                        for row, box in onward(group, x, limit, home, n):
                            no = np.full(len(row), np.nan)
                            add(rows[row], np.full(len(row), -1), no, no, box)
        v = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
        at = pa.array(v["_row"].astype(np.int64))
        cols = [pa.array(v["_box"].astype(np.int64))] + [pc.take(left.column(c), at) for c in ("_key", "_hash", *[f"_v{i}" for i in range(n)])]
        cols += [pa.array(v["col"].astype(np.int32)), pa.array(v["dist"].astype(float)), pa.array(v["value"].astype(float))]
        return pa.Table.from_arrays(cols, names=["_box", "_key", "_hash", *[f"_v{i}" for i in range(n)], "col", "dist", "value"])

    def meet(sent: DataFrame, forward: bool) -> DataFrame:
        """Rows meet the donors of their box; a box with very many rows is several parts, each with all of its donors."""
        crowded = sent.groupBy("_box").count().filter(F.col("count") > MOST_ASKS).collect()
        parts = F.lit(1)
        if crowded:
            parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for r in crowded for v in (r["_box"], -(-r["count"] // MOST_ASKS))]), F.col("_box")), F.lit(1))
        tasks = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = sent.withColumn("_part", F.pmod(F.xxhash64("_hash"), parts).cast("int"))
        right = donors.mapInArrow(given, routed).withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        left, right = (df.repartition(tasks, "_box", "_part").groupBy("_box", "_part") for df in (left, right))
        return left.cogroup(right).applyInArrow(lambda x, y: best(x, y, forward), met_schema)

    empty = asks.sparkSession.createDataFrame([], f"`{key}` {kind}, col int, dist double, value double")
    if not groups:
        return empty
    home = cut_lineage(meet(asks.mapInArrow(sent_home, routed), forward=True))
    away = home.filter("_box >= 0").select("_box", "_key", "_hash", *[f"_v{i}" for i in range(n)])
    found = home.filter("_box < 0")
    if away.head(1):
        found = found.unionByName(meet(away, forward=False))
    return found.select(F.col("_key").alias(key), "col", "dist", "value")


def distances(a, b, shared: int):
    """All pairs' distances by products of matrices; rows of one group and those that ask it have ``shared`` columns in common."""
    import numpy as np

    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a0, b0 = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    sq = (a0**2) @ mb.T - 2 * a0 @ b0.T + ma @ (b0**2).T
    return np.maximum(sq, 0.0) * a.shape[1] / shared


def onward(group: Group, x, limit, home: int, names: int):
    """(rows, boxes): the other boxes in which a row may find a donor as near as ``limit``.

    The limit is widened by more than a distance can be off: it is a difference of squares.
    """
    import numpy as np

    own = x[:, list(group.share)]
    low, high = own.min(axis=0), own.max(axis=0)
    squares = (own**2).sum(axis=1) + (np.maximum(np.abs(group.low), np.abs(group.high)).max(axis=0) ** 2).sum()
    limit = limit * (1 + 1e-9) + squares * (names / len(group.share)) * 1e-12
    gap = np.maximum(np.maximum(group.low - high, low - group.high), 0.0)
    near = (gap**2).sum(axis=1) * names / len(group.share) <= limit.max()
    which = np.flatnonzero(near & (group.box != home))
    for rows in np.array_split(np.arange(len(x)), 1 + len(x) * len(which) // MOST_PAIRS):
        r, at = np.nonzero(group.squares(x[rows], names, which) <= limit[rows][:, None])
        yield rows[r], group.box[which[at]]


def condensed(places, keys, values, k: int):
    """Rows in the order of values, without those that k others at the same place always come before."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    _, place = np.unique(places, axis=0, return_inverse=True)
    place = place.reshape(-1)
    if len(order) < 2 * k or place.max() * 4 > len(order):
        return order

    def first(rows, limit, *by):
        """Of the rows equal in ``by``, the first ``limit``."""
        at = np.lexsort((np.arange(len(rows)), *[b[rows] for b in by]))
        new = np.any([np.append(True, np.diff(b[rows[at]]) != 0) for b in by], axis=0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return rows[np.sort(at[np.arange(len(at)) - start < limit])]

    own = np.where(keys < 0, -2 - np.arange(len(keys)), keys)  # rows without key are not each other's
    return first(first(order, k, own, place), 2 * k, place)
