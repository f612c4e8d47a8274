"""The corpus pipeline against plain Python, stage by stage."""

import corpus_pipeline

from .brute import exact_groups, near_components, quality
from .conftest import SMALL


def test_stages(spark, documents, rows):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "bpe"]
    docs = stage["quality_rules"](spark, documents, SMALL)
    assert docs.columns == documents.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, t in rows:
        q = quality(t)
        if q["n_words"] < 50 or 2 * q["n_repeat_words"] > q["n_words"]:
            assert i not in kept
    docs = spark.createDataFrame(docs.collect(), documents.schema)
    docs = stage["exact_dedup"](spark, docs, SMALL)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {i for i, g in exact_groups(list(kept.items())).items() if g[2]}
    docs = spark.createDataFrame(docs.collect(), documents.schema)
    docs = stage["ngram_join"](spark, docs, SMALL)
    assert docs.columns == documents.columns
    one = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(one) == {c for _, c in near_components(list(left.items())).values()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
    assert out.count() > 0
