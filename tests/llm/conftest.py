import random

import pytest

from terracell.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORDS = "the of and to river stone market winter garden letter mountain yellow quiet engine paper window".split()


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SMALL, "documents").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture
def prose():
    def make(n, seed=0):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + (str(rnd.randint(0, 99)) if rnd.random() < 0.6 else "") for _ in range(n))

    return make
