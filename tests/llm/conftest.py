import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def make(rows, lang="en", source="s"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "ЖЖ", "x1"]) for _ in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, long), (7, long), (8, "one two three four"), (8, "one two three four"), (None, "one two three four"), (9, "Ünïcödé 😀 text"), (10, "x" * 50_000)]


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
