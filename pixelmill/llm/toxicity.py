"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence scores sigmoid(bias + sum of the weights of its words and word beginnings); a document
is toxic if any of its sentences is: 1 - product(1 - score), the noisy-or. The weights are trained
through that from document labels, and the sentence scores then say where the offence is.

Trained on a sample of at most `FIT_ROWS` labelled documents, always the same ones; null labels
are no labels, and of several labels of a document the highest counts. A null or empty text is one
empty sentence. Without any labelled row every sentence has the prior score. Ties and repeated
rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pixelmill.llm.tables import share, stage
from pixelmill.llm.textarrays import Texts, mix, slices, texts_of

#: Labelled documents that the fit may read; the driver gets the places of their telling features only.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Bytes of a word's beginning that count as a feature of their own.
BEGINNING = 4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each sentence that has a letter; sentences end after . ! ? or a newline."""
    stops = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_STOP[texts.data], out=stops[1:])
    starts, ends = texts.runs(_LETTER[texts.data])
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    name = stops[starts] + owner
    new = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(name)) - 1 if len(new) else new
    return starts[new], ends[last], owner[new]


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each word its sentence's number within `sentences`, and the word's two feature hashes."""
    low = texts.lower()
    starts, ends = low.runs(_LETTER[low.data])
    begin, _, _ = sentences(texts)
    of = np.searchsorted(begin, starts, "right") - 1
    head = np.minimum(ends, starts + BEGINNING)
    return of, np.stack([low.hash(starts, ends), mix(low.hash(starts, head) + np.uint64(1))], 1)


def noisy_or(p: np.ndarray, owner: np.ndarray, n: int, empty: float) -> np.ndarray:
    """1 - product(1 - p) over the sentences of each of n texts; texts without one have `empty`."""
    stay = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    return np.where(np.bincount(owner, minlength=n) > 0, -np.expm1(stay), empty)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class ToxicModel:
    """Weights by feature hash, sorted by hash; features without one weigh nothing."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray

    def sentence_scores(self, texts: Texts) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = sentences(texts)
        of, hashes = features(texts)
        total = np.full(len(found[0]), self.bias)
        if len(self.keys):
            for j in range(hashes.shape[1]):
                at = np.minimum(np.searchsorted(self.keys, hashes[:, j]), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == hashes[:, j])
                total += np.bincount(of[hit], self.weights[at[hit]], minlength=len(total))
        return _sigmoid(total), found

    def scores(self, texts: Texts) -> np.ndarray:
        p, (_, _, owner) = self.sentence_scores(texts)
        return noisy_or(p, owner, len(texts), float(_sigmoid(np.array(self.bias))))


def telling(counts: DataFrame, n_toxic: int, n_clean: int, least: int = 5, strength: float = 18.0) -> DataFrame:
    """The features of (key, toxic, clean) in at least `least` documents and commoner in toxic ones beyond chance.

    The test is a likelihood ratio; 18 is reached by chance once in 45,000 features.
    """
    n1, n0 = float(max(1, n_toxic)), float(max(1, n_clean))
    rate = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    part = lambda seen, n: seen * F.log(F.greatest(seen, F.lit(1e-9)) / (n * rate)) + (n - seen) * F.log(F.greatest(n - seen, F.lit(1e-9)) / F.greatest(n * (1 - rate), F.lit(1e-9)))
    ratio = 2 * (part(F.col("toxic").cast("double"), n1) + part(F.col("clean").cast("double"), n0))
    return counts.filter((F.col("toxic") + F.col("clean") >= least) & (F.col("toxic") / n1 > F.col("clean") / n0) & (ratio >= strength))


def train(n_keys: int, which: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> np.ndarray:
    """Gradient steps (Adam) on the documents' log loss through the noisy-or; the weights, then the bias.

    which, sentence: number of a feature and the sentence it is in; owner: the document of each
    sentence; label: 0 or 1 for each document.
    """
    theta = np.zeros(n_keys + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = len(owner)
    for step in range(1, rounds + 1):
        p = np.clip(_sigmoid(theta[-1] + np.bincount(sentence, theta[which], minlength=n)), 1e-12, 1 - 1e-9)
        doc = np.clip(noisy_or(p, owner, len(label), 0.5), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - doc) / doc for a toxic one.
        slope = p * np.where(label == 1, -(1 - doc) / doc, 1.0)[owner]
        grad = np.append(np.bincount(which, slope[sentence], minlength=n_keys), slope.sum()) / len(label)
        grad[:-1] += shrink * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
    return theta


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicModel:
    """Trains on at most `rows` labelled documents outside the held-out quarter, chosen by hash."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` rows of two numbers: a bounded broadcast, so that no text is shuffled.
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size:
        return ToxicModel(-3.0, np.zeros(0, np.uint64), np.zeros(0))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and clean documents of a slice each feature is."""
        for part in slices(batches, "text"):
            texts, label = texts_of(part.column(2)), part.column(1).to_numpy()
            _, _, owner = sentences(texts)
            of, hashes = features(texts)
            doc = np.repeat(owner[of] if len(of) else of, hashes.shape[1])
            keys, which = np.unique(hashes.ravel(), return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(texts) + doc)
            toxic = label[pairs % len(texts)] == 1
            counts = (np.bincount(pairs // len(texts), x, minlength=len(keys)).astype(np.int64) for x in (toxic, ~toxic))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], ["key", "toxic", "clean"])

    counts = sample.mapInArrow(seen, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Each of them is in 5 documents of the sample at least.
    keys = np.sort(telling(counts, size.get(1, 0), size.get(0, 0)).select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The telling features of each document by sentence."""
        for part in slices(batches, "text"):
            texts = texts_of(part.column(2))
            _, _, owner = sentences(texts)
            of, hashes = features(texts)
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[at] == hashes if len(keys) else np.zeros(hashes.shape, bool)
            word, side = np.nonzero(hit)
            many = np.bincount(owner, minlength=len(texts))
            doc = owner[of[word]]
            inside = of[word] - (np.cumsum(many) - many)[doc]
            cut = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(many.astype(np.int64)), pa.ListArray.from_arrays(cut, pa.array(inside)), pa.ListArray.from_arrays(cut, pa.array(at[word, side]))],
                ["doc_id", "toxic", "sentences", "inside", "which"],
            )

    drawn = sample.mapInArrow(places, "doc_id long, toxic int, sentences long, inside array<long>, which array<long>").toArrow().sort_by("doc_id").combine_chunks()
    label, many = drawn.column("toxic").to_numpy(), np.maximum(drawn.column("sentences").to_numpy(), 1)
    inside, which = (drawn.column(c).combine_chunks().flatten().to_numpy() for c in ("inside", "which"))
    first = np.repeat(np.cumsum(many) - many, pc.list_value_length(drawn.column("which")).to_numpy())
    theta = train(len(keys), which, inside + first, np.repeat(np.arange(len(many)), many), label)
    return ToxicModel(float(theta[-1]), keys, theta[:-1])


def score(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id, score, and the offending sentences as spans of bytes with their scores."""
    held = share(docs.sparkSession, model)  # FIT_ROWS documents' features at most
    key = T.StructField("doc_id", docs.schema[doc_id].dataType)
    spans = T.StructType.fromDDL("score double, offending array<struct<start:long,end:long,score:double>>")
    schema = T.StructType([key, *spans])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = float(_sigmoid(np.array(held().bias)))
        for part in slices(batches, "text"):
            texts = texts_of(part.column(1))
            p, (start, end, owner) = held().sentence_scores(texts)
            bad = np.flatnonzero(p >= THRESHOLD)
            cut = np.searchsorted(owner[bad], np.arange(len(texts) + 1)).astype(np.int32)
            begin = texts.offsets[owner[bad]]
            where = pa.StructArray.from_arrays([pa.array(start[bad] - begin), pa.array(end[bad] - begin), pa.array(p[bad])], ["start", "end", "score"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(noisy_or(p, owner, len(texts), empty)), pa.ListArray.from_arrays(pa.array(cut), where)], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def drop_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """The rows of `docs` whose score stays below the threshold, with all their columns."""
    held = share(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(held().scores(texts_of(part.column(text))) < THRESHOLD))

    return docs.mapInArrow(rows, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"),
    )
