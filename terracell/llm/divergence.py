"""Audit of how far the sources of a language diverge in their words.

A source's kept terms get smoothed shares of a thousand million, ``p = 1 + floor(10**9 * (count + 1) / (N + V))``;
two shares differ by ``floor((p - q)**2 / q)``. Sources are compared with each other source of their language over
all kept terms, and each source's terms with the whole language. All arithmetic is in whole numbers.

1. **Kept terms.** Tasks count in how many documents of a language a term occurs, counts are added by (language,
   term), and terms with ``least_docs`` or more stay.
2. **Transducers.** Kept terms are sorted by range over the cluster; each range becomes minimal acyclic
   transducers of at most ``SHARD_TERMS`` terms that give a term's ordinal. Offsets by running sums over the shards
   (a row of numbers each) make ordinals of all languages, a language's in one run.
3. **Recount.** The texts stream through the transducers again, and only (source, ordinal, count) leaves a
   task: no term is shuffled or kept a second time. Transducers are broadcast in packs of at most ``PACK_BYTES``;
   where the vocabulary is larger, the texts are read once for each pack, and the counts of the packs are
   disjoint.
4. **Comparison.** Terms that neither source has differ by a constant, and terms that one source has are
   taken from the source's histogram of counts, so the join by ordinal only meets counts that aren't zero.
   Ordinals break ties: their order is the byte order of the terms.

Text is worked on in pieces of ``PIECE`` bytes cut between terms, so memory follows neither the longest text nor the
number of terms a task meets (tables are passed on at ``HELD`` entries). The hot source's terms are dealt out by
ordinal; the best terms of a source are limited within each task before they meet.

Defined results: null text, language and source are empty strings; a text without terms, or an empty one, still makes
its (language, source) occur. A language without kept terms has values of 0. The only source of a language has
no pairs. Repeated rows count as documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import stored, whole, written
from terracell.llm.transducer import Transducer, Vocabulary

UNIT = 1_000_000_000
SHARD_TERMS = 100_000
PACK_BYTES = 64 << 20
PIECE = 1 << 20
HELD = 1_000_000
#: Bytes of a term to themselves, capital letters to small ones, all others to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``PIECE`` bytes."""
    raw = text.encode("utf-8").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(lang, group, text) rows."""
    for batch in batches:
        lang, group = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, text in enumerate(batch.column(2)):
            yield lang[i], group[i], text.as_py()


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a language with the term."""
    held: dict[str, Counter] = {}

    def told():
        for lang, found in held.items():
            terms = list(found)
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[t] for t in part], pa.int64())],
                    names=["lang", "term", "n"],
                )
        held.clear()

    entries = 0
    for lang, _, text in texts_of(batches):
        seen: set[bytes] = set()
        for terms in term_pieces(text):
            seen.update(terms)
        found = held.setdefault(lang, Counter())
        entries -= len(found)
        found.update(seen)
        entries += len(found)
        if entries > HELD:
            yield from told()
            entries = 0
    yield from told()


def build_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, first, n_terms, fst) of sorted (lang, term) rows."""
    lang, terms = None, []

    def built():
        if terms:
            fst = Transducer.build(terms).to_bytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([terms[0].decode("utf-8")]), pa.array([len(terms)], pa.int64()), pa.array([fst], pa.binary())],
                names=["lang", "first", "n_terms", "fst"],
            )
            terms.clear()

    for batch in batches:
        for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != lang or len(terms) >= SHARD_TERMS:
                yield from built()
                lang = own
            terms.append(term.encode("utf-8"))
    yield from built()


def vocabulary(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, first, n_terms, base, bytes, fst): the kept terms of each language as transducers of ranges."""
    counts = docs.mapInArrow(document_counts, "lang string, term string, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    kept = written(kept.select("lang", "term"), "kept-terms")
    shards = max(1, -(-kept.count() // SHARD_TERMS))
    ranged = kept.repartitionByRange(shards, "lang", "term").sortWithinPartitions("lang", "term")
    built = ranged.mapInArrow(build_batches, "lang string, first string, n_terms long, fst binary")
    built = written(built, "term-transducers")
    before = Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = built.select("lang", "first", "n_terms", F.length("fst").alias("bytes"))
    sizes = stored(sizes.withColumn("base", F.coalesce(F.sum("n_terms").over(before), F.lit(0))))
    return built.drop("n_terms").join(sizes, ["lang", "first"])


def packs_of(vocab: DataFrame) -> Iterator[dict[str, Vocabulary]]:
    """Transducers by language, at most ``PACK_BYTES`` at a time; a row of numbers a shard is read before."""
    sizes = sorted((r["lang"], r["first"].encode(), r["first"], r["bytes"]) for r in vocab.select("lang", "first", "bytes").collect())
    packs, total = [[]], 0
    for lang, _, first, size in sizes:
        if packs[-1] and total + size > PACK_BYTES:
            packs.append([])
            total = 0
        packs[-1].append((lang, first))
        total += size
    for pack in packs:
        wanted = vocab.sparkSession.createDataFrame(pack, "lang string, first string") if pack else None
        rows = vocab.join(F.broadcast(wanted), ["lang", "first"]).collect() if pack else []
        shards: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["lang"], r["first"].encode())):
            shards.setdefault(r["lang"], []).append((r["first"].encode(), r["base"], bytes(r["fst"])))
        yield {lang: Vocabulary(s) for lang, s in shards.items()}


def recount_batches(batches: Iterator[pa.RecordBatch], pack) -> Iterator[pa.RecordBatch]:
    """(group, ordinal, n): occurrences of kept terms."""
    held: dict[tuple[str, int], Counter] = {}
    known: dict[str, dict[bytes, int]] = {}

    def found_in(lang: str, terms: list[bytes]) -> np.ndarray:
        """Ordinals; a term walks the transducer once a task, as long as it is remembered."""
        own = known.setdefault(lang, {})
        new = [t for t in terms if t not in own]
        own.update(zip(new, pack.value[lang].ordinals(new).tolist()))
        return np.fromiter(map(own.__getitem__, terms), dtype=np.int64, count=len(terms))

    def told():
        for (lang, group), found in held.items():
            ordinal = found_in(lang, list(found))
            n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
            ordinal, n = ordinal[ordinal >= 0], n[ordinal >= 0]
            for a in range(0, len(n), 50_000):
                part = n[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), group, dtype=np.int64)), pa.array(ordinal[a : a + 50_000]), pa.array(part)],
                    names=["group", "ordinal", "n"],
                )
        held.clear()
        if sum(map(len, known.values())) > HELD:
            known.clear()

    entries = 0
    for lang, group, text in texts_of(batches):
        if lang not in pack.value:
            continue
        found = held.setdefault((lang, group), Counter())
        for terms in term_pieces(text):
            entries -= len(found)
            found.update(terms)
            entries += len(found)
            if entries > HELD:
                yield from told()
                entries = 0
                found = held.setdefault((lang, group), Counter())
    yield from told()


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ordinal, item) of (base, fst)."""
    for batch in batches:
        for base, fst in zip(*(batch.column(i).to_pylist() for i in range(2))):
            terms = [t.decode("utf-8") for t in Transducer.from_bytes(fst).terms()]
            for a in range(0, len(terms), 10_000):
                part = terms[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(base + a, base + a + len(part))), pa.array(part)], names=["ordinal", "item"]
                )


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), by decimals without a fraction."""
    top = (count + 1).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + kept).cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); the square of at most UNIT fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(group, ordinal, n) of every kept term that occurs in a source."""
    found = None
    for pack in packs_of(vocab):
        sent = docs.sparkSession.sparkContext.broadcast(pack)
        part = docs.mapInArrow(
            lambda batches, sent=sent: recount_batches(batches, sent), "group long, ordinal long, n long"
        )
        found = part if found is None else found.unionByName(part)
    return written(found.groupBy("group", "ordinal").agg(F.sum("n").alias("n")), "term-counts")


def group_number(seed: int) -> Column:
    return F.xxhash64("lang", "source", F.lit(seed))


def numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, group) and the seed of a hash that tells all groups apart."""
    groups = written(groups, "sources")
    for seed in range(10):
        out = groups.withColumn("group", group_number(seed))
        if not out.groupBy("group").count().where("count > 1").head(1):
            return out, seed
    raise RuntimeError("no hash of ten tells the sources apart")


def source_pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(group, other, value) of each two sources of a language.

    ``groups`` has (group, lang, kept, p0), p0 the share of a term that the source lacks; ``terms`` has
    (group, ordinal, p0, p). Sources are numbers here.
    """

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c if c in ("lang", "ordinal") else f"{c}_{side}") for c in df.columns])

    def told(df: DataFrame, value: Column) -> DataFrame:
        return df.select("group_a", "group_b", value.alias("value"))

    apart = F.col("group_a") != F.col("group_b")
    p_a, p_b, a0, b0 = (F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b"))
    none = gap(a0, b0)
    base = told(named(groups, "a").join(named(groups, "b"), "lang").where(apart), F.coalesce(F.col("kept_a") * none, F.lit(0)))
    counts = terms.groupBy("group", "p").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.join(groups.select("group", "lang", "p0"), "group"), "share-counts")
    own = told(named(counts, "a").join(named(groups, "b"), "lang").where(apart), F.col("n_a") * (gap(p_a, b0) - none))
    other = told(named(groups, "a").join(named(counts, "b"), "lang").where(apart), F.col("n_b") * (gap(a0, p_b) - none))
    met = named(terms, "a").join(named(terms, "b"), "ordinal").where(apart)
    both = told(met, gap(p_a, p_b) - gap(p_a, b0) - gap(a0, p_b) + none)
    every = base.unionByName(own).unionByName(other).unionByName(both)
    return every.groupBy(F.col("group_a").alias("group"), F.col("group_b").alias("other")).agg(F.sum("value").alias("value"))


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language and its divergence, all ranks; part ``term``: the ``top``
    terms that a source has more often than its language. Ranks fall by value, then by the item's bytes.
    """
    lang, source = whole(F.col(lang_col).cast("string")), whole(F.col(source_col).cast("string"))
    docs = df.select(lang.alias("lang"), source.alias("source"), whole(text_col).alias("text"))
    groups, seed = numbered(docs.select("lang", "source").distinct())
    docs = docs.select("lang", group_number(seed).alias("group"), "text")
    vocab = written(vocabulary(docs, least_docs), "vocabulary")
    counts = counted(docs, vocab)

    kept = vocab.groupBy("lang").agg(F.sum("n_terms").alias("kept"))
    sums = counts.groupBy("group").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(kept, "lang", "left").join(sums, "group", "left")
    groups = groups.select("lang", "source", "group", F.coalesce("kept", zero).alias("kept"), F.coalesce("total", zero).alias("total"))
    empty = F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))
    groups = written(groups.withColumn("p0", empty), "source-totals")

    terms = counts.join(groups.select("group", "total", "kept", "p0"), "group")
    terms = terms.select("group", "ordinal", "p0", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    terms = written(terms, "term-shares")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_group = groups.join(of_lang, "lang").select("group", "lang_total", "kept")
    # a term's ordinal belongs to one language
    in_lang = counts.join(written(of_group, "language-totals"), "group").groupBy("ordinal")
    in_lang = in_lang.agg(F.sum("n").alias("n"), F.max("lang_total").alias("total"), F.max("kept").alias("kept"))
    in_lang = in_lang.select("ordinal", share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))

    names = groups.select("group", "lang", "source")
    pairs = source_pairs(groups.select("group", "lang", "kept", "p0"), terms)
    others = names.select(F.col("group").alias("other"), F.col("source").alias("item"))
    pairs = pairs.join(others, "other").withColumn("rank", ranked("item"))
    more = terms.join(in_lang, "ordinal").where("p > q").select("group", "ordinal", gap(F.col("p"), F.col("q")).alias("value"))
    more = stored(more.withColumn("rank", ranked("ordinal")).where(F.col("rank") <= top))
    spelled = vocab.select("base", "fst").mapInArrow(term_batches, "ordinal long, item string")
    more = more.join(spelled, "ordinal")

    def part(rows: DataFrame, name: str) -> DataFrame:
        rank = F.col("rank").cast("int").alias("rank")
        return rows.join(names, "group").select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)

    return part(pairs, "pair").unionByName(part(more, "term"))


def ranked(tie: str) -> Column:
    return F.row_number().over(Window.partitionBy("group").orderBy(F.desc("value"), tie))
