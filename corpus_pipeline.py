"""Documents to packed training sequences, one operator of `pixelmill.llm` per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import minhash, packing, quality, repeats, toxicity
from pixelmill.llm.encoding import word_encoder
from pixelmill.llm.tables import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules accept."""
    return quality.keep(docs, quality.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; trained on the labels of those that came this far."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; null ids stay."""
    return minhash.drop_near_duplicates(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier in the corpus."""
    return repeats.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their ids, and their places in sequences of 2048."""
    return packing.pack(docs, word_encoder(public_tokenizers.path("word_bpe_49k.json")), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("best_fit_packing", pack),
]

#: Several stages are learned or tokenised, which SQL cannot express; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
