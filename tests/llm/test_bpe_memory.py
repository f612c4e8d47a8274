"""What encoding holds in memory: small batches, packed ids."""

import random
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from terracell.llm import bpe
from terracell.llm.common import BATCH_BYTES, BATCH_SETTING
from terracell.llm.queries import vocabulary_path


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})


def test_texts_come_in_small_batches(spark):
    """A task with 32 MB of texts: Spark's default hands it over as one batch."""
    own = spark.newSession()
    docs = own.range(0, 3200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    out = bpe.digests(docs, vocabulary_path())
    got = docs.mapInArrow(sizes, "bytes long").collect()
    assert sum(r["bytes"] for r in got) > 3200 * 10_000
    assert max(r["bytes"] for r in got) < 2 * BATCH_BYTES
    assert [tuple(r) for r in out.groupBy("n_tokens").count().collect()] == [(2001, 3200)]


def test_a_session_keeps_its_own_size(spark):
    own = spark.newSession()
    own.conf.set(BATCH_SETTING, "1m")
    bpe.digests(own.createDataFrame([(1, "a b")], "doc_id long, text string"), vocabulary_path())
    assert own.conf.get(BATCH_SETTING) == "1m"


def test_remembered_ids_are_packed():
    """Four bytes an id and one object a run; equal single tokens are one object."""
    with open(vocabulary_path(), encoding="utf-8") as f:
        model = bpe.BytePairs.from_json(f.read())
    model.ready()
    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(10**6)}z" for _ in range(3000)) + " the the"
    ids = model.encode(text)
    held = [*model.runs.values()]
    assert len(held) > 2900 and sum(map(sys.getsizeof, held)) <= sum(sys.getsizeof(b"") + len(v) for v in held)
    assert sum(map(len, held)) <= 4 * len(ids)
    assert model.runs[" the"] is model.alone[model.id_of[b" the"]]
