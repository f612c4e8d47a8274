"""Near copies by b-bit MinHash.

A document is its set of distinct word shingles. ``HASHES`` one-to-one maps scramble a shingle, the
minimum under each is a sample of the set: two sets agree in a minimum with the probability of their
Jaccard similarity.

1. **Bands.** ``ROWS`` minima make one key, the key of a band. Two documents of similarity s share one of the
   bands with probability 1 - (1 - s**4)**32; a pair just at 0.8 is missed with probability 5e-8.
2. **Packed signatures.** Of every minimum only ``BITS`` low bits stay, sixteen in a 64-bit number, 64 bytes a
   document. Two documents that meet in a key are compared by bit counts of the exclusive or; chance
   equals of low bits are taken off: ``(share of equal groups - 2**-b) / (1 - 2**-b)`` estimates the
   similarity. Pairs whose estimate a pair at the threshold reaches but once in ``MISS`` are dropped.
3. **Confirmation.** What is left is compared on the full sets, recomputed from the texts of the documents
   in such pairs only. Links that would join what is joined already are not fetched.

**Hot keys**, held by more than ``KEY_MEMBERS`` documents, make no pairs: their documents are first linked to
one document of each key, another one for each key. Documents outside the largest component that a hot key then
holds are compared with all documents of that key in blocks of about ``BLOCK`` shingles each way, dealt out over the
cluster: signature against signature, and the sets of those that come near, without leaving the block. A block returns
one link for each node and component at most. Nothing is capped. The work of a key is its number of
documents times the number still apart: near linear for groups of near copies, quadratic (in bit
counts) where many texts share a key and are no copies.

Copies: documents of one set are one node. Shuffles: 32 keys of 16 bytes a document (pre-aggregated), 64-byte
signatures, full sets of confirmed candidates only, star components.

Defined results: a null or empty text and one of white space only have no shingles and are linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle. Ids may have any type that
can be ordered. A null id is an id like others, but a component is named by its least id that isn't null, and by
null where there is none; ``kept`` compares null as equal to null. An id that repeats with different
texts is in the component of each text. Equal rows stay, each in the result. Shingles, sets and whole texts are told apart
by 64-bit hashes. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from terracell.llm.common import stored, whole, written
from terracell.llm.graph import components
from terracell.llm.ngram_join import (
    BROADCAST_IDS,
    cross_pairs,
    node_of,
    scrambled,
    set_batches,
    shingle_set,
    text_key,
    verified,
    with_components,
)

HASHES = 128
ROWS = 4
BITS = 4
WORDS_OF_64 = HASHES * BITS // 64
MISS = 1e-9
KEY_MEMBERS = 8
BLOCK = 100_000
SLICE = 500
STEP = 32_768
#: The lowest bit of every group of four.
GROUPS = np.uint64(0x1111111111111111)
#: The odd factors of the maps, from a fixed rule.
FACTORS = scrambled(np.arange(HASHES, dtype=np.uint64), 77) | np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(HASHES, sets): the least scrambled shingle of each set under each map.

    Shingles are hashes already, so an odd factor is enough of a map. Sets are laid end to end and cut into
    steps, so memory does not follow the longest text.
    """
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    every = np.concatenate(sets)
    out = np.full((HASHES, len(sets)), np.uint64(2**64 - 1))
    buffer = np.empty(STEP, dtype=np.uint64)
    for a in range(0, len(every), STEP):
        part = every[a : a + STEP]
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, a + len(part), "left"))
        local = np.maximum(starts[first:last] - a, 0)
        for i in range(HASHES):
            x = np.multiply(part, FACTORS[i], out=buffer[: len(part)])
            row = out[i, first:last]
            np.minimum(row, np.minimum.reduceat(x, local), out=row)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, bands): one number for each band of minima."""
    keys = []
    for band in range(HASHES // ROWS):
        total = np.full(least.shape[1], band, dtype=np.uint64)
        for i in range(ROWS):
            total = scrambled(total ^ least[band * ROWS + i], i)
        keys.append(total)
    return np.stack(keys, axis=1).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """(sets, 8): low bits of the minima, scrambled first so that they do not follow the shingle's own."""
    low = scrambled(least, 9) & np.uint64((1 << BITS) - 1)
    low = low.reshape(WORDS_OF_64, 64 // BITS, -1)
    shift = np.arange(0, 64, BITS, dtype=np.uint64)[None, :, None]
    return np.ascontiguousarray(np.bitwise_or.reduce(low << shift, axis=1).T).view(np.int64)


@cache
def least_equal(num: int, den: int) -> int:
    """Equal groups that a pair of similarity num/den has, but for one case in ``1 / MISS``."""
    chance = 2.0**-BITS
    p = num / den * (1 - chance) + chance
    below = 0.0
    for m in range(HASHES + 1):
        below += math.comb(HASHES, m) * p**m * (1 - p) ** (HASHES - m)
        if below > MISS:
            return m
    return HASHES


def estimate(equal: Column | float) -> Column | float:
    """Similarity from the number of equal groups, without those that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def equal_groups(a: Column, b: Column) -> Column:
    """Groups of bits that two packed signatures have in common, by bit counts."""
    total = F.lit(HASHES)
    for i in range(WORDS_OF_64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(int(GROUPS)))
        total = total - F.bit_count(x)
    return total


def sign_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, text_key, node, n, sig, keys) of (id, text, text_key); no words: null node, signature and keys."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, SLICE):
            batch = whole_batch.slice(at, SLICE)
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            full = [i for i, s in enumerate(sets) if len(s)]
            spare = np.ones(len(sets), dtype=bool)
            spare[full] = False
            place = np.zeros(len(sets), dtype=np.int64)
            place[full] = np.arange(len(full))
            place = pa.array(place, mask=spare)
            node = pa.array([node_of(sets[i]) for i in full], pa.int64())
            least = minima([sets[i] for i in full]) if full else np.zeros((HASHES, 0), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    node.take(place),
                    pa.array([len(s) for s in sets], pa.int64()),
                    lists(packed(least)).take(place),
                    lists(band_keys(least)).take(place),
                ],
                names=["id", "text_key", "node", "n", "sig", "keys"],
            )


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def close(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate comes near it."""
    one = sigs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = sigs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    met = pairs.join(one, "a").join(two, "b")
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    return met.where(sizes & (equal_groups(F.col("sig_a"), F.col("sig_b")) >= least_equal(num, den))).select("a", "b")


def hot_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(node, sig, keys, shingles) of texts."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, SLICE):
            sets = [shingle_set(t.as_py(), words) for t in whole_batch.column(0).slice(at, SLICE)]
            least = minima(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.int64()), lists(packed(least)), lists(band_keys(least)), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "sig", "keys", "shingles"],
            )


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def compare_blocks(left: pa.Table, right: pa.Table, num: int, den: int) -> pa.Table:
    """Links of a block that join components; at most one for each node and component.

    A pair is looked at in the first band that it shares; pairs whose signatures come near the similarity are
    compared on their sets, all partners of a node at once.
    """
    found_a: list[int] = []
    found_b: list[int] = []
    if left.num_rows and right.num_rows:
        least = least_equal(num, den)
        node, comp = right["node"].to_numpy(), right["component"].to_numpy()
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in right["shingles"]]
        size = np.array([len(s) for s in sets])
        sigs, keys = numbers(right["sig"]).view(np.uint64), numbers(right["keys"])
        own_sigs, own_keys = numbers(left["sig"]).view(np.uint64), numbers(left["keys"])
        band = int(np.flatnonzero(keys[0] == right["key"][0].as_py())[0])
        for i, (a, c, v) in enumerate(zip(left["node"].to_pylist(), left["component"].to_pylist(), left["shingles"])):
            s = np.frombuffer(v.as_buffer(), dtype=np.uint64)
            near = np.flatnonzero((comp != c) & (np.minimum(size, len(s)) * den >= np.maximum(size, len(s)) * num))
            x = sigs[near] ^ own_sigs[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            near = near[HASHES - np.bitwise_count(x & GROUPS).sum(axis=1, dtype=np.int64) >= least]
            if band:
                near = near[~(keys[near, :band] == own_keys[i, :band]).any(axis=1)]
            for at in range(0, len(near), 256):
                part = near[at : at + 256]
                flat = np.concatenate([sets[k] for k in part])
                place = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                starts = np.cumsum(size[part]) - size[part]
                both = np.add.reduceat((s[place] == flat).astype(np.int64), starts)
                good = part[den * both >= num * (len(s) + size[part] - both)]
                _, first = np.unique(comp[good], return_index=True)
                found_a.extend([a] * len(first))
                found_b.extend(node[good[first]].tolist())
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def block_links(hot: DataFrame, comps: DataFrame, sigs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links between components that share a hot key, found block against block."""
    spread = stored(with_components(hot.join(sigs.select("node", "n"), "node"), comps))
    sizes = spread.groupBy("key", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    largest = F.max(F.struct("count", "component", "n"))
    main = sizes.groupBy("key").agg(largest.alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"))
    main = main.where("components > 1").select(
        "key", F.col("main.component").alias("main"), F.ceil(F.col("n") / BLOCK).alias("rights"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("lefts")
    )
    met = stored(spread.join(stored(main), "key").select("key", "main", "lefts", "rights", "node", "component"))
    texts = one_text_each(docs, rows, met)
    sets = texts.mapInArrow(lambda batches: hot_batches(batches, words), "node long, sig array<long>, keys array<long>, shingles binary")
    sets = written(sets.dropDuplicates(["node"]), "minhash-hot-sets")

    def dealt(df: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("node", F.lit(own)), F.col(own_blocks)))
        df = df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_blocks) - 1)))
        df = df.join(sets, "node")
        columns = ("key", "i", "j", "node", "component", "sig", "keys", "shingles")
        # new columns for each side, or the cogroup takes them for the same
        return df.select(*[F.when(F.lit(True), F.col(c)).alias(c) for c in columns]).groupBy("key", "i", "j")

    left = dealt(met.where("component <> main"), "i", "lefts", "j", "rights")
    right = dealt(met, "j", "rights", "i", "lefts")
    return left.cogroup(right).applyInArrow(lambda a, b: compare_blocks(a, b, num, den), "a long, b long").distinct()


def key_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: all of a key with few members, each member and one of a hot key.

    The one differs from key to key, so that members of a large group meet many of its documents.
    """
    cold = keyed.where(F.col("members") <= KEY_MEMBERS)
    one = cold.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # KEY_MEMBERS at most
    one = one.select("nodes", F.posexplode("nodes").alias("at", "a"))
    one = one.select("a", F.explode(F.slice("nodes", F.col("at") + 2, F.lit(KEY_MEMBERS))).alias("b"))
    star = keyed.where(F.col("members") > KEY_MEMBERS).select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b"))
    return one.unionByName(star).where("a <> b").distinct()


def near_rows(df: DataFrame, words: int, num: int, den: int, text_col: str, id_col: str) -> DataFrame:
    """(id, n, component_id) of every row."""
    docs = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), text_key(text_col).alias("text_key"))
    longs = ArrayType(LongType(), False)
    fields = [docs.schema["id"], *[StructField(c, LongType()) for c in ("text_key", "node", "n")]]
    schema = StructType([*fields, StructField("sig", longs), StructField("keys", longs)])
    signed = written(docs.mapInArrow(lambda batches: sign_batches(batches, words), schema), "minhash-rows")

    full = signed.where("node is not null")
    sigs = written(full.select("node", "n", "sig").dropDuplicates(["node"]), "minhash-signatures")
    keys = written(full.select(F.explode("keys").alias("key"), "node").distinct(), "minhash-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("node", F.xxhash64("node", "key")).alias("one"))
    keyed = written(keys.join(shared.where("members > 1"), "key"), "minhash-shared")
    hot = keyed.where(F.col("members") > KEY_MEMBERS).select("key", "node")
    pairs = stored(close(key_pairs(keyed), sigs, num, den))

    # each node's least candidate is confirmed first; of the rest only pairs of two components
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = stored(verified(first, full_sets(docs, full, first, words), num, den))
    rest = stored(cross_pairs(pairs, stored(components(links))))
    more = verified(rest, full_sets(docs, full, rest, words), num, den)
    links = stored(links.unionByName(more))
    more = block_links(hot, stored(components(links)), sigs, docs, full, words, num, den)
    comps = components(stored(links.unionByName(more)))

    name = F.min("id").alias("component_id")  # nulls do not count
    of_node = stored(with_components(full.groupBy("node").agg(F.min("id").alias("id")), comps))
    of_node = stored(of_node.select("node", "component").join(of_node.groupBy("component").agg(name), "component"))
    rows = full.select("id", "node", "n").join(of_node.select("node", "component_id"), "node")
    alone = signed.where("node is null").select("id", "n", F.col("id").alias("component_id"))
    return rows.select("id", "n", "component_id").unionByName(alone)


def one_text_each(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text) of the rows that have a node's least text key."""
    keys = rows.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    keys = stored(keys.select("text_key").distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(keys, "text_key", "left_semi").select("text")


def full_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs``, from the texts of one row each."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = one_text_each(docs, rows, ends).mapInArrow(lambda batches: set_batches(batches, words), "node long, shingles binary")
    return written(sets.dropDuplicates(["node"]), "minhash-sets")


def near_components(
    df: DataFrame, words: int = 5, num: int = 3, den: int = 4, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; links are similarities of num/den or more.

    The chance of a miss above holds for thresholds of 0.8; at 0.75 a pair just at the threshold is missed once
    in 200,000.
    """
    out = near_rows(df, words, num, den, text_col, id_col)
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept)
