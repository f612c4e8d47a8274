"""N-gram Jaccard self join by parity sketches.

A document is its set of distinct word shingles. A shingle hash picks one of P parts and one of 2**32
bits in the part; the sketch has a bit set where an odd number of the set's shingles fall. Each shingle
in one set only flips at most one bit, so the Hamming distance of two sketches bounds the symmetric
difference from below. Only few bits are set, so a part is kept as the XOR of random codes of its set
bits, one 64-bit number.

Similarity of ``num/den`` or more means a symmetric difference of at most
``(den - num) / (den + num)`` of the sizes' sum. Pairs are cut into bands by that sum, each a doubling,
with P a little over the bound D of the band: at least ``k`` parts then hold equal shingles in both
sets (pigeonhole). A document takes part in the one or two bands that its partners' sizes allow, and
each part that isn't empty becomes a key (band, part, number). Documents that meet in a key are
candidates, and candidates are verified on the sets.

**Empty parts** are no keys. A document whose empty parts alone could be all that it shares (``k`` or
more) also sends the keys of another seed, until one is good for it.

**Hot keys**, held by more than ``KEY_MEMBERS`` documents, make no pairs. A document with fewer than k
hot or empty parts shares another key with each partner, so nothing is lost. The rest, whose parts
nearly all are hot (large groups of near copies), are linked first to one representative of the key
they share most; those whose keys then still hold several components are compared within clusters of
documents that these keys connect (``crowded_clusters``), each a grid of bounded blocks. That is exact
and makes no pairs: a block returns at most one link for each document and component.

Copies: documents of one set are one node (a hash of the set), sent once for each task. Keys that are
hot within one chunk of a task are dealt out by node, not by key, so that no task gets a large group.

Defined results: null and empty texts have the empty set, are linked with nothing and form components
of their own; with fewer words than a shingle the whole sequence is the one shingle; repeated rows are
copies. A null id is an id like others, but for the name of its component: that is the least id, null
where no row of the component has one. An id that repeats with different texts is in the component of
each text. Words, sets and whole texts are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import fresh, shuffles_freed, stored, whole, written
from terracell.llm.graph import components

KEY_MEMBERS = 8
BANDS = 40
SEEDS = 8
CHUNK_KEYS = 500_000
BLOCK = 4000
BLOCK_SHINGLES = 1_500_000
BROADCAST_IDS = 1_000_000
DOC, KEY, PAIR, HOT = 0, 1, 2, 3
ROWS = "kind long, a long, b long, x long, y long"
SEND = "deal long, key long, node long, x long"


class WordHashes(dict):
    """64-bit hashes of words, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHashes()
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def scrambled(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * ODD[1]
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    # on bytes, lower() and split() know ASCII only: A-Z and the six characters of white space
    found = text.encode("utf-8").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, found), dtype=np.uint64, count=n)
    size = min(words, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = scrambled(total ^ h[i : n - size + 1 + i], i)
    return np.unique(total)


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    sums = np.array([scrambled(s, 101).sum(dtype=np.uint64), scrambled(s, 102).sum(dtype=np.uint64)])
    both = scrambled(sums, len(s))
    return int((both[:1] ^ (both[1:] * ODD[0])).view(np.int64)[0])


class Bands:
    """Sizes of sketches: by band b, for pairs whose sizes add up to 2**b or more, below 2**(b+1)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        most = [((2 << b) - 1) * (den - num) // (den + num) for b in range(BANDS)]
        self.parts = [d + 3 + d * 2 // 25 for d in most]

    def of(self, n: int) -> range:
        """Bands in which a set of n can have partners."""
        least, most = n + -(-n * self.num // self.den), n + n * self.den // self.num
        return range(least.bit_length() - 1, most.bit_length())

    def equal_parts(self, n: int, band: int) -> int:
        """Parts that any partner in the band has in common at least."""
        most = min(n + n * self.den // self.num, (2 << band) - 1)
        return self.parts[band] - most * (self.den - self.num) // (self.den + self.num)

    def sketch(self, s: np.ndarray, band: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(number, part) of the parts that have a bit set."""
        h = scrambled(s, 1000 + seed)
        h.sort()
        p = np.uint64(self.parts[band])
        part = ((h >> np.uint64(32)) * p) >> np.uint64(32)  # rises with h
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(2**40)))
        bits = scrambled(h & np.uint64(0xFFFFFFFF), 7)
        number = np.bitwise_xor.reduceat(bits, first)
        part = part[first]
        keep = number != 0
        return number[keep], part[keep]


def packed(n: int, spare: int, seed: int, band: int) -> int:
    """What a key says of its document: size, hot parts that do no harm, seed, band."""
    return (n << 30) | (min(max(spare, 0), (1 << 19) - 1) << 10) | (seed << 6) | band


HOT_BIT = np.int64(1 << 29)
BAND_MASK = np.int64(63)


def size_in(x: Column) -> Column:
    return F.shiftright(x, 30)


def spare_in(x: Column) -> Column:
    return F.shiftright(x, 10).bitwiseAND((1 << 19) - 1)


def send_batches(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int):
    """Documents and their sketch keys, as rows of ``SEND``; documents have -1 - size for x and their text's
    hash for key. A null to deal by stands for the key, which is not sent twice."""
    bands, seen = Bands(num, den), set()
    keys: list[np.ndarray] = []
    owners: list[tuple[int, int, int]] = []
    held = 0

    def flush():
        """Keys that are hot in this chunk are dealt out by node, but for one row."""
        if not keys:
            return
        key = np.concatenate(keys)
        count = np.array([c for _, _, c in owners])
        node = np.repeat(np.array([n for n, _, _ in owners], dtype=np.int64), count)
        x = np.repeat(np.array([p for _, p, _ in owners], dtype=np.int64), count)
        order = np.argsort(key, kind="stable")
        key, node, x = key[order], node[order], x[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(starts, append=len(key))
        hot = np.repeat(size > KEY_MEMBERS, size)
        first = np.zeros(len(key), dtype=bool)
        first[starts] = True
        deal = np.where(hot & ~first, scrambled(node.view(np.uint64), 5).view(np.int64), key)
        x = np.where(hot, x | HOT_BIT, x)
        for a in range(0, len(key), 50_000):
            b = a + 50_000
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal[a:b], mask=deal[a:b] == key[a:b]), pa.array(key[a:b]), pa.array(node[a:b]), pa.array(x[a:b])],
                names=["deal", "key", "node", "x"],
            )
        keys.clear()
        owners.clear()

    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        docs, nodes, sizes = [], [], []
        for i, t in zip(ids.to_pylist(), batch.column(1)):
            s = shingle_set(t.as_py(), words)
            n = len(s)
            docs.append(i)
            sizes.append(n)
            if not n:
                nodes.append(None)
                continue
            node = node_of(s)
            nodes.append(node)
            if node in seen:
                continue
            if len(seen) < 300_000:
                seen.add(node)
            for band in bands.of(n):
                need = bands.equal_parts(n, band)
                for seed in range(SEEDS):
                    number, part = bands.sketch(s, band, seed)
                    spare = need - (bands.parts[band] - len(number))
                    key = scrambled(number ^ scrambled(part, 50 + band), 200 + seed).view(np.int64)
                    keys.append(key)
                    owners.append((node, packed(n, spare, seed, band), len(key)))
                    held += len(key)
                    if spare > 0:
                        break
            if held > CHUNK_KEYS:
                yield from flush()
                held = 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()),
                batch.column(2),
                pa.array(nodes, pa.int64()),
                pa.array([-1 - n for n in sizes], pa.int64()),
            ],
            names=["deal", "key", "node", "x"],
        )
    yield from flush()


def rows_batch(kind: int, a, b, x, y) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.array(np.full(n, kind, dtype=np.int64)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in (a, b, x, y))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "x", "y"])


def meet_batches(batches: Iterator[pa.RecordBatch], num: int, den: int):
    """Rows of ``ROWS`` from key rows sorted by (key, node): documents pass, small groups make pairs, hot ones
    are told. A group is held until it ends or is hot, so a task keeps a batch and few rows."""
    empty = np.zeros(0, dtype=np.int64)
    held = (empty, empty, empty)
    hot_key = hot_node = None

    def group_rows(key, node, x):
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        size = np.diff(starts, append=len(key))
        told = np.logical_or.reduceat((x & HOT_BIT) != 0, starts)
        hot = np.repeat((size > KEY_MEMBERS) | told, size)
        if hot.any():
            yield rows_batch(HOT, key[hot], node[hot], x[hot] & ~HOT_BIT, x[hot] & 0)
        key, node, x = key[~hot], node[~hot], x[~hot]
        for d in range(1, KEY_MEMBERS):
            i = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else empty
            if not len(i):
                break
            xa, xb = x[i], x[i + d]
            na, nb = xa >> 30, xb >> 30
            good = (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (
                np.floor(np.log2((na + nb).astype(np.float64))).astype(np.int64) == (xa & BAND_MASK)
            )
            i = i[good]
            if len(i):
                yield rows_batch(PAIR, node[i], node[i + d], x[i], x[i + d])

    for batch in batches:
        if not batch.num_rows:
            continue
        is_doc = batch.column(3).to_numpy(zero_copy_only=False) < 0
        if is_doc.any():
            d = batch.filter(pa.array(is_doc))
            yield rows_batch(DOC, d.column(0), d.column(2), -1 - d.column(3).to_numpy(zero_copy_only=False), d.column(1))
            batch = batch.filter(pa.array(~is_doc))
        key, node, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        key, node, x = (np.concatenate([h, v]) for h, v in zip(held, (key, node, x)))
        if not len(key):
            continue
        # copies that several tasks have sent; a mark of heat stays
        same = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
        if same.any():
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            key, node, x = key[starts], node[starts], np.bitwise_or.reduceat(x, starts)
        if hot_key is not None:
            still = np.flatnonzero(key == hot_key)
            if len(still):
                fresh = still[node[still] != hot_node]
                if len(fresh):
                    hot_node = node[fresh[-1]]
                    yield rows_batch(HOT, key[fresh], node[fresh], x[fresh] & ~HOT_BIT, x[fresh] & 0)
                left = np.ones(len(key), dtype=bool)
                left[still] = False
                key, node, x = key[left], node[left], x[left]
                if not len(key):
                    held = (empty, empty, empty)
                    continue
            hot_key = None
        tail = int(np.flatnonzero(key == key[-1])[0])
        if len(key) - tail > KEY_MEMBERS:
            hot_key, hot_node, tail = key[-1], node[-1], len(key)
        if tail:
            yield from group_rows(key[:tail], node[:tail], x[:tail])
        held = (key[tail:], node[tail:], x[tail:])
    if len(held[0]):
        yield from group_rows(*held)


def set_batches(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "shingles"],
        )


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def verify_batches(batches: Iterator[pa.RecordBatch], num: int, den: int):
    for batch in batches:
        keep = []
        for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3))):
            p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (p, q))
            both = overlap(p, q)
            if den * both >= num * (len(p) + len(q) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    rows = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return rows.mapInArrow(lambda batches: verify_batches(batches, num, den), "a long, b long")


def compare_blocks(left: pa.Table, right: pa.Table, num: int, den: int) -> pa.Table:
    """Links of each left set to the right ones of other components, one for each component."""
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in right["shingles"]]
        size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        right_node = right["node"].to_numpy()
        right_comp = right["component"].to_numpy()
        for node, comp, v in zip(left["node"].to_pylist(), left["component"].to_pylist(), left["shingles"]):
            s = np.frombuffer(v.as_buffer(), dtype=np.uint64)
            a, b = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero((den * both >= num * (len(s) + size - both)) & (right_comp != comp))
            _, first = np.unique(right_comp[good], return_index=True)
            out.extend((node, int(right_node[good[i]])) for i in first)
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def with_components(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    return nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cross_pairs(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("a", "b"):
        c = comps.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        pairs = pairs.join(c, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return pairs.where("c_a <> c_b").select("a", "b")


def candidates(found: DataFrame, hot_count: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) that share as many keys as the pigeonhole asks for.

    Of the parts that must be equal, some may be empty or hot in both; their number is known for each
    document. Pairs that met under a later seed are not filtered.
    """
    pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b", "x", "y").count()
    for end, x in (("a", "x"), ("b", "y")):
        h = hot_count.select(F.col("node").alias(end), F.col("x").alias(x), F.col("n_hot").alias(f"hot_{end}"))
        pairs = pairs.join(h, [end, x], "left")
    parts = F.element_at(F.array(*[F.lit(p) for p in bands.parts]), (F.col("x").bitwiseAND(63) + 1).cast("int"))
    num, den = bands.num, bands.den

    def equal(total: Column) -> Column:
        return parts - F.floor(total * F.lit(den - num) / F.lit(den + num))

    def other(x: Column, hot: str) -> Column:
        """Empty and hot parts of one document."""
        n = size_in(x)
        band_most = F.expr("shiftleft(2L, cast(x & 63 as int))") - 1
        own = equal(F.least(n + F.floor(n * F.lit(den) / F.lit(num)), band_most))
        return own - spare_in(x) + F.coalesce(hot, F.lit(0))

    x, y = F.col("x"), F.col("y")
    need = equal(size_in(x) + size_in(y))
    unsure = (spare_in(x) == 0) | (spare_in(y) == 0) | (F.shiftright(x, 6).bitwiseAND(7) > 0)
    enough = F.col("count") + F.least(other(x, "hot_a"), other(y, "hot_b")) >= need
    return pairs.where(unsure | enough).select("a", "b").distinct()


def jaccard_components(
    df: DataFrame, words: int = 5, num: int = 3, den: int = 4, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; links are similarities of num/den or more."""
    with shuffles_freed(df.sparkSession):
        out = placed_rows(df, words, num, den, text_col, id_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def text_key(text: str) -> Column:
    return F.xxhash64(whole(text))


def placed_rows(df: DataFrame, words: int, num: int, den: int, text_col: str, id_col: str) -> DataFrame:
    """(id, text_key, node, n, component_id, stays) of every row.

    One (id, text_key) of each component stays: that of the least id, null last, then of the least node
    and text key. Rows without words stay.
    """
    bands = Bands(num, den)
    docs = df.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"), text_key(text_col).alias("text_key"))
    sent = docs.mapInArrow(lambda batches: send_batches(batches, words, num, den), SEND)
    met = sent.repartition(F.coalesce("deal", "key")).sortWithinPartitions("key", "node")
    found = written(met.mapInArrow(lambda batches: meet_batches(batches, num, den), ROWS), "sketch-rows")

    rows = found.where(F.col("kind") == DOC)
    rows = rows.select(F.col("a").alias("id"), F.col("b").alias("node"), F.col("x").alias("n"), F.col("y").alias("text_key"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key"))
    nodes = rows.where("node is not null").groupBy("node").agg(first.alias("first"))
    nodes = stored(nodes.select("node", "first.no_id", "first.id", "first.text_key"))

    hot = found.where(F.col("kind") == HOT).select(F.col("a").alias("key"), F.col("b").alias("node"), "x").distinct()
    hot_count = stored(hot.groupBy("node", "x").agg(F.count(F.lit(1)).alias("n_hot")))
    crowded = hot_count.where(F.col("n_hot") >= spare_in(F.col("x"))).select("node", "x")
    hot = stored(hot.join(crowded, ["node", "x"], "left_semi"))
    pairs = stored(candidates(found, hot_count, bands))

    active = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    active = active.unionByName(hot.select("node")).distinct()
    keys = stored(nodes.join(active, "node", "left_semi").select("text_key").distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    sets = docs.join(keys, "text_key", "left_semi").select("text")
    sets = sets.mapInArrow(lambda batches: set_batches(batches, words), "node long, shingles binary")
    sets = written(sets.dropDuplicates(["node"]), "sketch-sets")

    links = first_links(pairs, hot, sets, num, den)
    comps = stored(components(links))
    more = verified(cross_pairs(pairs, comps), sets, num, den)
    more = more.unionByName(block_links(hot, comps, sets, num, den))
    links = stored(links.unionByName(more))
    comps = components(links)

    of_node = stored(with_components(nodes, comps))
    least = of_node.groupBy("component").agg(F.min(F.struct("no_id", "id", "node", "text_key")).alias("least"))
    least = stored(
        least.select(
            "component", F.col("least.id").alias("component_id"), F.col("least.node").alias("least_node"), F.col("least.text_key").alias("least_key")
        )
    )
    of_node = of_node.select("node", "component").join(least, "component").drop("component")
    of_node = stored(of_node)
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("least_node")) & (F.col("text_key") == F.col("least_key"))
    out = rows.where("node is not null").join(of_node, "node")
    out = out.select("id", "text_key", "node", "n", "component_id", stays.alias("stays"))
    alone = rows.where("node is null")
    return out.unionByName(alone.select("id", "text_key", "node", "n", F.col("id").alias("component_id"), F.lit(True).alias("stays")))


def first_links(pairs: DataFrame, hot: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each node to its least candidate, and of crowded ones to a hot key's representative."""
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    stands = stored(hot.groupBy("key").agg(F.min("node").alias("rep")))
    shared = hot.join(stands, "key").where("rep <> node").groupBy("node", "rep").count()
    best = shared.groupBy("node").agg(F.max_by("rep", "count").alias("rep"))
    star = best.select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return stored(verified(least.unionByName(star).distinct(), sets, num, den))


def crowded_clusters(hot: DataFrame, comps: DataFrame) -> DataFrame:
    """(unit, node, n, component, outside, cluster) of the crowded nodes that may have links to other components.

    A node has a unit in each of its bands and seeds. Two similar nodes that share no other key share at least
    ``spare`` hot ones. So each leaves out ``spare - 1`` keys, those of several components and the most members
    first: that order is the same for both, and the first in it of what they share is left out by neither. Units
    that share such a key of several components are of one cluster; of two similar nodes of two components one is
    outside the largest component of their key.
    """
    spread = stored(with_components(hot.select("key", "node", "x"), comps))
    several = (F.min("component") < F.max("component")).alias("several")
    of_key = stored(spread.groupBy("key").agg(several, F.count(F.lit(1)).alias("members")))
    order = Window.partitionBy("node", "x").orderBy(F.desc("several"), F.desc("members"), "key")
    kept = spread.join(of_key, "key").withColumn("at", F.row_number().over(order))
    kept = kept.where(F.col("several") & (F.col("at") >= spare_in(F.col("x"))))
    kept = stored(kept.select("key", F.xxhash64("node", "x").alias("unit"), "node", size_in(F.col("x")).alias("n"), "component"))

    of_key = kept.groupBy("key", "component").agg(F.count(F.lit(1)).alias("count"), F.min("unit").alias("rep"))
    main, left = F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("left")
    of_key = stored(of_key.groupBy("key").agg(main, F.min("rep").alias("rep"), left).where("left > 1").select("key", "main", "rep"))
    met = stored(kept.join(of_key, "key").select("rep", "unit", "node", "n", "component", (F.col("component") != F.col("main")).alias("outside")))
    clusters = components(met.select(F.col("rep").alias("a"), F.col("unit").alias("b")).distinct())
    clusters = stored(clusters.select(F.col("node").alias("unit"), F.col("component").alias("cluster")))
    units = met.groupBy("unit", "node", "n", "component").agg(F.max("outside").alias("outside"))
    return stored(units.join(clusters, "unit"))


def block_links(hot: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of crowded nodes whose hot keys hold several components: what is outside the largest component of a
    key against all of its cluster, in a grid of bounded blocks."""
    units = crowded_clusters(hot, comps)
    nodes = stored(units.select("node").distinct())
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    sets = written(sets.join(nodes, "node", "left_semi"), "sketch-crowded-sets")

    def blocks(only: Column, name: str) -> Column:
        rows, shingles = F.count_if(only), F.sum(F.when(only, F.col("n")).otherwise(0))
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).alias(name)

    grid = stored(units.groupBy("cluster").agg(blocks(F.col("outside"), "lefts"), blocks(F.lit(True), "rights")))
    units = stored(units.join(grid, "cluster"))

    def dealt(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("node", F.lit(own)), F.col(own_blocks)))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1)))
        df = df.join(sets, "node")
        columns = ("cluster", "i", "j", "node", "component", "shingles")
        # new columns for each side, or the cogroup takes them for the same
        return df.select(*[F.when(F.lit(True), F.col(c)).alias(c) for c in columns]).groupBy("cluster", "i", "j")

    left = dealt(units.where("outside"), "i", "lefts", "j", "rights")
    right = dealt(units, "j", "rights", "i", "lefts")
    return left.cogroup(right).applyInArrow(lambda a, b: compare_blocks(a, b, num, den), "a long, b long").distinct()


def drop_near_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of ``df`` of each group of near copies: that of the least id, null last.

    Ties are broken by hashes of set and text; of rows that repeat id and text one stays. Rows without
    words are copies of nothing: they stay, but for those that repeat an id and a text.
    """
    options = {"words": 5, "num": 3, "den": 4} | options
    with shuffles_freed(df.sparkSession):
        rows = stored(placed_rows(df, text_col=text_col, id_col=id_col, **options).select("id", "text_key", "node", "stays"))
        gone = stored(rows.where("not stays").select("id", "text_key").distinct())
        again = rows.where("stays and (node is not null or id is not null)").groupBy("id", "text_key").count()
        again = stored(again.where("count > 1").select("id", "text_key"))

    key = fresh(df, "text_key")
    keyed = df.withColumn(key, text_key(text_col))
    left = matched(keyed, gone, key, id_col, "left_anti")
    if again.count():
        one = matched(left, again, key, id_col, "left_semi").dropDuplicates([id_col, key])
        left = matched(left, again, key, id_col, "left_anti").unionByName(one)
    return left.select(*df.columns)


def matched(df: DataFrame, rows: DataFrame, key: str, id_col: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` on id and text key, null ids equal."""
    other_id, other_key = fresh(df, "other_id"), fresh(df, "other_key")
    rows = rows.select(F.col("id").alias(other_id), F.col("text_key").alias(other_key))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    same = F.col(id_col).cast("long").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))
    return df.join(rows, same, how)
