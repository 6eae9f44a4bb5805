import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

WORDS = "the of and token alpha beta gamma delta Über straße año naïve x1 42 foo, bar. baz; qux".split()


def corpus(seed=0, n=60):
    """Small documents with copies, shared lines, empty, null and long texts; unique doc_ids."""
    r = random.Random(seed)
    lines = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 14))) for _ in range(40)]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 8))) for _ in range(n)]
    texts += [texts[3], texts[3], "", None, " \n\t", "a", "long " * 3000, "z" * 4000, "\n".join(lines[:5]) * 2]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(pairs, parts=3):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(make_docs):
    return make_docs(corpus())
