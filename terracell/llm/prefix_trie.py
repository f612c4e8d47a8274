"""Trie of the common beginnings of conversations, by composable fingerprints.

A conversation is rebuilt from the first ``h`` turns of its base (the conversation that opens its group of
``GROUP`` ids) and its own turns after its first ``h``; ``h`` is the unsigned CRC-32 of the decimal id, modulo ``HEADS``.
A node is a distinct sequence of first turns.

**Monoid of hash products.** A turn is an affine map ``x -> a*x + b`` modulo the prime 2**61 - 1, in two lanes, with
numbers from hashes of role and text; a sequence of turns is the composition of its maps, and its
fingerprint is the image of a fixed point. Compositions are associative and can be undone, so:

- products along a conversation are a scan in two levels: turns are sorted by range over the cluster, each task
  composes within its rows, and the products of whole pieces (two rows a task at most) are composed on the driver;
- a rebuilt conversation is never written out. If P is the product of its own turns before the cut and f the
  fingerprint of the base's head, ``y = P**-1(f)`` is one point for each conversation, and the fingerprint of head
  and own turns up to m is that of m's product at y.

**Groups.** Rows (conversation, depth, fingerprint, reference to the turn) are grouped by depth and fingerprint.
Groups are verified: all rows of a group have one parent, and every turn that is referred to and isn't the least
member's own is compared with that one by the SHA-256 of role and text. A mismatch starts again with other hashes.

**Subtrees** need no walk: each node's weight stands at its least member's row, weights are summed from a
conversation's end (in blocks of ``STRETCH`` depths, so that a very long conversation is many tasks), and the sums of a
node's members are the subtree's. **Digests** of ends: ids are sorted by range, joined to pieces of ``PIECE_IDS``, and
hashed as a stream, so no list of ids is held.

Shuffles: narrow rows only; texts are read twice and never moved. A node that holds all conversations is
pre-aggregated, joins on parents can be split.

Defined results: null role and text are empty strings; a null turn comes first; turns that tie are ordered by the hashes
of role and text, equal rows are turns of their own. Rows without ``conv_id`` belong to no conversation and are left
out. Without conversations there is no root: an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import WORD, stored, whole, written

GROUP = 20
HEADS = 4
PRIME = (1 << 61) - 1
START = (0x2545F4914F6CDD1D % PRIME, 0x1D872B41C0F3A5E7 % PRIME)
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ALL_BITS = (1 << 64) - 1
STRETCH = 4096
PIECE_IDS = 2000
ATTEMPTS = 3

Product = tuple[int, int, int, int]
ONE: Product = (1, 0, 1, 0)


def turn_map(t1: int, t2: int) -> Product:
    """The two lanes' a and b of a turn from two hashes."""
    t1, t2 = t1 & ALL_BITS, t2 & ALL_BITS
    return (1 + t1 % (PRIME - 1), t2 % PRIME, 1 + (t1 * MIX[0] + t2) % (PRIME - 1), (t2 * MIX[1] + t1) % PRIME)


def then(first: Product, second: Product) -> Product:
    """``first`` and after it ``second``."""
    a, b, c, d = first
    e, f, g, h = second
    return (a * e % PRIME, (e * b + f) % PRIME, c * g % PRIME, (g * d + h) % PRIME)


def image(of: Product, point: tuple[int, int]) -> tuple[int, int]:
    return (of[0] * point[0] + of[1]) % PRIME, (of[2] * point[1] + of[3]) % PRIME


def origin(of: Product, point: tuple[int, int]) -> tuple[int, int]:
    """The point whose image is ``point``."""
    return (point[0] - of[1]) * pow(of[0], -1, PRIME) % PRIME, (point[1] - of[3]) * pow(of[2], -1, PRIME) % PRIME


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


PIECES = ["part", "conv", "at", "t1", "t2", "ref", "words", "a1", "b1", "a2", "b2"]


def compose_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PIECES`` of sorted (conv, t1, t2, ref, words): place and product before the turn, both within the task.

    A negative place is that of a whole piece and its product; the first and the last conversation of a
    task have one.
    """
    part = TaskContext.get().partitionId()
    conv, at, product, pieces = None, 0, ONE, 0
    for batch in batches:
        rows = []
        for own, t1, t2, ref, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if own != conv:
                if pieces == 1:
                    rows.append((part, conv, -at, 0, 0, 0, 0, *product))
                conv, at, product, pieces = own, 0, ONE, pieces + 1
            at += 1
            rows.append((part, conv, at, t1, t2, ref, words, *product))
            product = then(product, turn_map(t1, t2))
        yield batch_of(rows, PIECES)
    if pieces:
        yield batch_of([(part, conv, -at, 0, 0, 0, 0, *product)], PIECES)


def carries(pieces: DataFrame) -> dict[tuple[int, int], tuple[int, Product]]:
    """(part, conv): turns before the piece and their product, where there are any. Two rows a task are read."""
    out, before = {}, {}
    ends = pieces.where("at < 0").select("part", "conv", "at", "a1", "b1", "a2", "b2").distinct().collect()
    for r in sorted(ends, key=lambda r: r["part"]):
        n, product = before.get(r["conv"], (0, ONE))
        if n:
            out[r["part"], r["conv"]] = n, product
        before[r["conv"]] = n - r["at"], then(product, (r["a1"], r["b1"], r["a2"], r["b2"]))
    return out


TURNS = ["conv", "pos", "t1", "t2", "ref", "words", "a1", "b1", "a2", "b2"]


def carried_batches(batches: Iterator[pa.RecordBatch], before) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for part, conv, at, t1, t2, ref, words, *product in zip(*(batch.column(i).to_pylist() for i in range(11))):
            n, first = before.value.get((part, conv), (0, ONE))
            rows.append((conv, at + n, t1, t2, ref, words, *then(first, tuple(product))))
        yield batch_of(rows, TURNS)


def longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def turn_rows(df: DataFrame, seed: int) -> DataFrame:
    """``TURNS``: every turn's place in its conversation and the product of the turns before it."""
    role, text = whole("role"), whole("text")
    rows = df.select(
        "conv", "turn",
        F.xxhash64(role, text, F.lit(2 * seed)).alias("t1"), F.xxhash64(text, role, F.lit(2 * seed + 1)).alias("t2"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )
    rows = rows.withColumn("ref", reference())
    order = ["conv", F.asc_nulls_first("turn"), "t1", "t2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "t1", "t2", "ref", "words")
    pieces = written(ranged.mapInArrow(compose_batches, longs(PIECES)), "trie-pieces")
    before = df.sparkSession.sparkContext.broadcast(carries(pieces))
    turns = pieces.where("at > 0").mapInArrow(lambda batches: carried_batches(batches, before), longs(TURNS))
    return written(turns, "trie-turns")


def reference() -> Column:
    """What a turn is found by within its conversation; equal rows have the same."""
    return F.xxhash64(F.coalesce(F.col("turn"), F.lit(0)), F.col("turn").isNull(), "t1", "t2")


HEAD = ["base", "d", "f1", "f2", "p1", "p2", "words", "ref"]


def head_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``HEAD`` of ``TURNS`` rows: fingerprints with and without the turn, from the start."""
    for batch in batches:
        rows = []
        for conv, pos, t1, t2, ref, words, *product in zip(*(batch.column(i).to_pylist() for i in range(10))):
            parent = image(tuple(product), START)
            rows.append((conv, pos, *image(turn_map(t1, t2), parent), *parent, words, ref))
        yield batch_of(rows, HEAD)


ROWS = ["conv", "d", "f1", "f2", "p1", "p2", "words", "ref_conv", "ref", "length"]


def origin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, h, head, y1, y2) of (conv, h, head, f1, f2, a1, b1, a2, b2)."""
    for batch in batches:
        rows = []
        for conv, h, head, f1, f2, *product in zip(*(batch.column(i).to_pylist() for i in range(9))):
            rows.append((conv, h, head, *origin(tuple(product), (f1, f2))))
        yield batch_of(rows, ["conv", "h", "head", "y1", "y2"])


def own_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``ROWS`` of own turns after the head: ``TURNS`` with h, head, y1, y2, length."""
    for batch in batches:
        rows = []
        for conv, pos, t1, t2, ref, words, a1, b1, a2, b2, h, head, y1, y2, length in zip(
            *(batch.column(i).to_pylist() for i in range(15))
        ):
            parent = image((a1, b1, a2, b2), (y1, y2))
            rows.append((conv, head + pos - h, *image(turn_map(t1, t2), parent), *parent, words, conv, ref, length))
        yield batch_of(rows, ROWS)


def rebuilt_rows(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``ROWS`` of every rebuilt conversation and depth from 1 on, (conv, length) of every conversation)."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    convs = stored(convs.select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"), (crc % HEADS).alias("h")))
    bases = convs.where("conv = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left")
    head = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = convs.withColumn("head", head)
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    convs = written(convs.select("conv", "n", "base", "h", "head", "length"), "trie-conversations")

    early = turns.where(F.col("pos") <= HEADS)
    heads = early.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).mapInArrow(head_batches, longs(HEAD))
    heads = stored(heads)
    of_base = convs.join(heads, "base").where("d <= head")
    of_base = of_base.select("conv", "d", "f1", "f2", "p1", "p2", "words", F.col("base").alias("ref_conv"), "ref", "length")

    more = convs.where("n > h").select("conv", "h", "head", "base")
    ends = heads.select("base", F.col("d").alias("head"), "f1", "f2")
    more = more.join(ends, ["base", "head"], "left")
    cut = early.select("conv", (F.col("pos") - 1).alias("h"), "a1", "b1", "a2", "b2")
    more = more.join(cut, ["conv", "h"])
    start = [F.coalesce(f, F.lit(x).cast("long")).alias(f) for f, x in zip(("f1", "f2"), START)]
    more = more.select("conv", "h", "head", *start, "a1", "b1", "a2", "b2")
    points = stored(more.mapInArrow(origin_batches, longs(["conv", "h", "head", "y1", "y2"])))
    points = stored(points.join(convs.select("conv", "length"), "conv"))
    own = turns.join(points, "conv").where("pos > h").select(*TURNS, "h", "head", "y1", "y2", "length")
    rows = of_base.unionByName(own.mapInArrow(own_batches, longs(ROWS)))
    return written(rows, "trie-rows"), convs.select("conv", "length")


NODE = ["d", "f1", "f2"]


def nodes_of(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes from depth 1 on with least member, members and parent; whether each has one parent."""
    parents = F.max(F.col("p1")) == F.min(F.col("p1")), F.max(F.col("p2")) == F.min(F.col("p2"))
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.max("words").alias("words"), (parents[0] & parents[1]).alias("one_parent"),
    )
    nodes = written(nodes, "trie-nodes")
    return nodes.drop("one_parent"), not nodes.where("not one_parent").head(1)


def same_turns(rows: DataFrame, nodes: DataFrame, df: DataFrame, seed: int) -> bool:
    """Whether every turn that a group refers to equals the one of its least member."""
    shared = nodes.where("n_convs > 1").select(*NODE, "conv")
    least = rows.join(stored(shared), [*NODE, "conv"]).select(*NODE, F.col("ref_conv").alias("to_conv"), F.col("ref").alias("to_ref"))
    every = rows.select(*NODE, "ref_conv", "ref").distinct()
    pairs = every.join(stored(least), NODE).where("ref_conv <> to_conv or ref <> to_ref")
    pairs = stored(pairs.select("ref_conv", "ref", "to_conv", "to_ref").distinct())
    role, text = whole("role"), whole("text")
    turns = df.select(
        "conv", "turn", F.xxhash64(role, text, F.lit(2 * seed)).alias("t1"), F.xxhash64(text, role, F.lit(2 * seed + 1)).alias("t2"),
        F.sha2(F.concat_ws("\0", F.length(role).cast("string"), role, text), 256).alias("digest"),
    )
    turns = stored(turns.select("conv", reference().alias("ref"), "digest").distinct())
    one = turns.select(F.col("conv").alias("ref_conv"), "ref", F.col("digest").alias("one"))
    two = turns.select(F.col("conv").alias("to_conv"), F.col("ref").alias("to_ref"), F.col("digest").alias("two"))
    met = pairs.join(one, ["ref_conv", "ref"]).join(two, ["to_conv", "to_ref"])
    return not met.where("one <> two").head(1)


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``NODE``, n_leaves and saved_tokens, for depths from 1 on. ``nodes`` has n_children."""
    weights = nodes.select(
        "conv", "d", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    zero = F.lit(0).cast("long")
    stretch = F.floor(F.col("d") / STRETCH).alias("stretch")
    own = rows.select("conv", *NODE, stretch).join(weights, ["conv", "d"], "left")
    own = own.withColumns({"leaf": F.coalesce("leaf", zero), "saved": F.coalesce("saved", zero)})
    later = Window.partitionBy("conv").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv", "stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = blocks.select("conv", "stretch", *[F.coalesce(F.sum(c).over(later), zero).alias(f"later_{c}") for c in ("leaf", "saved")])
    from_end = Window.partitionBy("conv", "stretch").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("conv", "stretch", *NODE, *[F.sum(c).over(from_end).alias(c) for c in ("leaf", "saved")])
    own = own.join(blocks, ["conv", "stretch"])
    return own.groupBy(*NODE).agg(
        F.sum(F.col("leaf") + F.col("later_leaf")).alias("n_leaves"), F.sum(F.col("saved") + F.col("later_saved")).alias("saved_tokens")
    )


def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, f1, f2, first, ids): decimal ids joined by commas, of rows sorted by node and id."""
    node, ids = None, []

    def told():
        return pa.RecordBatch.from_arrays(
            [*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"]
        )

    for batch in batches:
        for *own, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if ids and (own != node or len(ids) >= PIECE_IDS):
                yield told()
                ids = []
            node = own
            ids.append(conv)
    if ids:
        yield told()


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, f1, f2, ends_sha256) of pieces sorted by node and first id; a piece is held at a time."""
    node, sha, out = None, None, []

    def told():
        cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[3] for r in out], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if own == node:
                sha.update(b",")
            else:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = own, hashlib.sha256()
            sha.update(ids.encode())
        yield told()
        out.clear()
    if node is not None:
        out.append((*node, sha.hexdigest()))
        yield told()


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``NODE`` and ends_sha256 of the nodes where a conversation ends."""
    start = [F.lit(x).cast("long").alias(f) for f, x in zip(("f1", "f2"), START)]
    ends = rows.where("d = length").select(*NODE, "conv")
    ends = ends.unionByName(convs.where("length = 0").select(F.col("length").alias("d"), *start, "conv"))
    order = [*NODE, "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(joined_batches, f"{longs([*NODE, 'first'])}, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(digest_batches, f"{longs(NODE)}, ends_sha256 string")


NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)


def prefix_trie(df: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    df = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", "text")
    for seed in range(ATTEMPTS):
        rows, convs = rebuilt_rows(turn_rows(df, seed))
        nodes, one_parent = nodes_of(rows)
        if one_parent and same_turns(rows, nodes, df, seed):
            break
    else:
        raise RuntimeError(f"fingerprints of {ATTEMPTS} seeds met in different turns")

    zero = F.lit(0).cast("long")
    children = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    children = stored(children.agg(F.count(F.lit(1)).alias("n_children")))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = written(nodes, "trie-counted")
    sums = stored(subtree_sums(rows, nodes))

    whole_table = convs.agg(F.min("conv"), F.count(F.lit(1))).first()
    if not whole_table[1]:
        return rows.sparkSession.createDataFrame([], NODES)
    leaves, saved = sums.where("d = 1").agg(F.sum("n_leaves"), F.sum("saved_tokens")).first()
    tops = nodes.where("d = 1").count()
    root = (0, *START, whole_table[0], None, whole_table[1], tops, leaves or 1, saved or 0)
    columns = [*NODE, "conv", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = rows.sparkSession.createDataFrame([root], longs(columns))

    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    top = nodes.where("d = 1").withColumn("parent_conv_id", F.lit(whole_table[0]))
    deeper = nodes.where("d > 1").join(stored(parents), ["d", "p1", "p2"])
    every = top.unionByName(deeper).join(sums, NODE).select(*columns).unionByName(root.select(*columns))
    every = every.join(stored(end_digests(rows, convs)), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return every.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
