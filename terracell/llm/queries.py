"""Registered queries of the text operators: each one runs its operator over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import (
    bpe,
    divergence,
    exact_dedup,
    license_scan,
    minhash,
    mixing,
    ngram_join,
    oracles,
    pii,
    prefix_trie,
    quality_rules,
    secret_scan,
    sharding,
    weak_labels,
)
from terracell.llm.common import table, whole, without_spaces

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(without_spaces(whole("text")), 256))
    out = exact_dedup.exact_dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of ``text`` and the text they decode to, as digests; other columns stay."""
    return bpe.digests(docs, path or vocabulary_path())


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_personal_data(docs).drop("text")
    return out.select("doc_id", *[count_of(k) for k in pii.BASE], *span_digests(pii.BASE))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def span_digests(base: tuple[str, ...]) -> list[Column]:
    """base_sha256 and spans of an array of (kind, start, end)."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return [F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")]


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    out = secret_scan.find_secrets(docs, model)
    base_digest, spans = span_digests(secret_scan.BASE)
    return out.select("doc_id", *[count_of(k) for k in secret_scan.BASE], base_digest, spans)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan_licences(docs)
    return out.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort("licenses"), ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
    )


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_labels.classify(docs).drop("text")


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents"), words=4, num=4, den=5)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL |= {
    "op3_exact_dedup": oracles.EXACT_DEDUP,
    "op5_ngram_join": oracles.near_copies(5, 75),
    "op10_quality_rules": oracles.quality_rules(),
    "op11_minhash": oracles.near_copies(4, 80, ", d.doc_id = component_id AS kept"),
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
