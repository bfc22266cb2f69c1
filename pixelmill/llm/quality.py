"""Quality rules as weak supervision: each rule votes good, votes bad or abstains on a text.

Expectation-maximisation over the counts of vote patterns estimates how often each rule is right
on good and on bad texts; the posterior of a pattern then replaces "every rule must pass".
The patterns number 3^8 at most, whatever the corpus, and each batch sends its counts only.

Null or empty texts have no words: every rule but the length rule abstains. Repeated rows and
ties get equal results; an empty table gives an empty result; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pixelmill.llm.textarrays import Texts, lines, mix, repeated, slices, texts_of, windows

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes good up to `good`, bad from `bad` on, else abstains; on fewer than `least` words it abstains."""

    name: str
    good: float
    bad: float
    least: int = 1


#: The quantities are arranged so that large means bad.
RULES = (
    Rule("few_words", -50, -10, 0),
    Rule("word_length_off", 1.3, 2.0),
    Rule("symbols", 0.05, 0.3),
    Rule("dup_lines", 0.1, 0.4, 10),
    Rule("repeat_words", 0.05, 0.3, 10),
    Rule("few_letters", -0.72, -0.6),
    Rule("few_distinct", -0.4, -0.2, 30),
    Rule("open_lines", 0.3, 0.8, 10),
)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".!?:;\"')")] = True


def measure(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The metrics of each text, and its vote pattern as a number with one base-3 digit per rule."""
    n_texts, owner = len(texts), texts.owner
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    count = lambda who, mask: np.bincount(who[mask], minlength=n_texts)
    first_byte = (texts.data & 0xC0) != 0x80
    n_words = np.diff(texts.first)
    chars = texts.per_text(texts.solid & first_byte)

    starts, ends, of = lines(texts)
    filled = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(texts.solid, out=filled[1:])
    real = filled[ends] > filled[starts]
    starts, ends, of = starts[real], ends[real], of[real]
    _, again = repeated(mix(texts.hash(starts, ends) + salt[of]))
    n_lines = np.bincount(of, minlength=n_texts)
    # The last solid byte of a line says whether it is closed.
    last = np.searchsorted(filled, filled[ends], "left") - 1
    open_lines = count(of, ~_CLOSES[texts.data[last]])

    hashes = texts.word_hashes
    runs = windows(hashes, WINDOW)
    inside = owner[: len(runs)] == owner[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = repeated(mix(runs[at] + salt[owner[at]]))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    _, known = repeated(mix(hashes + salt[owner]))

    metrics = {
        "n_words": n_words, "word_chars": chars, "n_symbols": texts.per_text(_IS_SYMBOL[texts.data]),
        "n_dup_lines": count(of, again), "n_repeat_words": count(owner, covered),
    }
    some, some_lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    amounts = (
        -n_words,
        np.abs(chars / some - 5.2),
        metrics["n_symbols"] / some,
        metrics["n_dup_lines"] / some_lines,
        metrics["n_repeat_words"] / some,
        -texts.per_text(_IS_LETTER[texts.data] & first_byte) / np.maximum(texts.per_text(first_byte), 1),
        -(n_words - count(owner, known)) / some,
        open_lines / some_lines,
    )
    pattern = np.zeros(n_texts, np.int64)
    for rule, amount in zip(RULES, amounts, strict=True):
        vote = np.where(amount >= rule.bad, 2, np.where(amount <= rule.good, 1, 0))
        pattern = pattern * 3 + np.where(n_words >= rule.least, vote, 0)
    return metrics, pattern


def base_failed(metrics: dict[str, np.ndarray]) -> np.ndarray:
    return (metrics["n_words"] < 10) | (100 * metrics["n_repeat_words"] > 20 * metrics["n_words"])


@dataclass(frozen=True)
class RuleModel:
    """good_right, bad_right: how often each rule's vote is right on good and on bad texts."""

    prior_good: float
    good_right: tuple[float, ...]
    bad_right: tuple[float, ...]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a text with this vote pattern is good."""
        good, bad = _digits(patterns)
        odds = np.full(len(patterns), np.log(self.prior_good) - np.log1p(-self.prior_good))
        for j, (a, b) in enumerate(zip(self.good_right, self.bad_right, strict=True)):
            odds += good[:, j] * np.log(a / (1 - b)) + bad[:, j] * np.log((1 - a) / b)
        return 1 / (1 + np.exp(-odds))


def _digits(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    votes = np.stack([patterns // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], 1)
    return votes == 1, votes == 2


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, weight: float = 20.0) -> RuleModel:
    """Expectation-maximisation over vote patterns and their counts.

    `weight` is the strength, in votes, of the prior belief: a rule is right on 95 % of good texts
    and finds 30 % of the bad ones. A vote never counts against its own meaning, so the classes
    cannot change places; without any text the prior belief stands.
    """
    good, bad = _digits(patterns)
    p_good = np.where(bad.sum(1) == 0, 0.95, np.where(bad.sum(1) == 1, 0.4, 0.05))
    model = RuleModel(0.9, (0.95,) * len(RULES), (0.3,) * len(RULES))
    for _ in range(rounds if len(patterns) else 0):
        is_good, is_bad = counts * p_good, counts * (1 - p_good)
        prior = (is_good.sum() + 0.9 * weight) / (counts.sum() + weight)
        right, found = [], []
        for j in range(len(RULES)):
            a = (is_good @ good[:, j] + 0.95 * weight) / (is_good @ (good[:, j] | bad[:, j]) + weight)
            b = (is_bad @ bad[:, j] + 0.3 * weight) / (is_bad @ (good[:, j] | bad[:, j]) + weight)
            a = min(max(a, 0.6), 0.999)
            right.append(float(a))
            found.append(float(min(max(b, 1 - a + 1e-3), 0.999)))
        model = RuleModel(float(min(max(prior, 0.5), 0.999)), tuple(right), tuple(found))
        p_good = model.posterior(patterns)
    return model


def fit(docs: DataFrame, text: str = "text") -> RuleModel:
    """Estimates the rules' accuracies from the votes on every text."""
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(RULES), np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(measure(texts_of(part.column(0)))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])

    rows = (
        docs.select(F.col(text).alias("text")).mapInArrow(votes, "pattern long, n long")
        .groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3^8 rows at most
    )
    return estimate(np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], float))


def score(docs: DataFrame, model: RuleModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: its id, the metrics, base_failed, the posterior of being good, kept."""
    key = T.StructField("doc_id", docs.schema[doc_id].dataType)
    schema = T.StructType([key, *(T.StructField(m, T.LongType()) for m in METRICS), T.StructField("base_failed", T.BooleanType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            metrics, pattern = measure(texts_of(part.column(1)))
            failed, good = base_failed(metrics), model.posterior(pattern)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(metrics[m].astype(np.int64)) for m in METRICS), pa.array(failed), pa.array(good), pa.array(~failed & (good >= 0.5))],
                schema.names,
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def keep(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is kept."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            metrics, pattern = measure(texts_of(part.column(text)))
            yield part.filter(pa.array(~base_failed(metrics) & (model.posterior(pattern) >= 0.5)))

    return docs.mapInArrow(rows, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
