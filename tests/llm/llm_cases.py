"""Rows that every operator must take, and fixtures of tables."""

import pytest
from pyspark.sql import types as T

from conftest import SF

#: Nulls, blanks, ties, copies under other ids, repeated rows, one word, and one very long text.
LONG = " ".join(f"w{k * k % 977}x{k}" for k in range(30_000))
EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a text without any number of its own"), (None, None),
        (6, LONG), (7, LONG), (8, "ünï çödé 日本語 \U0001f600 " * 40), (9, "a" * 500), (10, "#$%& " * 60)]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.IntegerType()), T.StructField("bucket", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators use inside, from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", len(t) if t is not None else None, "x", 1, None) for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
