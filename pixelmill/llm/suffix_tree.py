"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to three words. The tree is grown level by level: a context seen at least
`least_seen` times in the training texts is counted with its next words; a context is kept as a
state if the divergence of its next words from what its suffix predicts outweighs the
description of its list (half a logarithm of its count per listed word). A state lists next words
with probability `GAMMA` or more, discounted, and shares what is left among all other words as
its longest kept suffix does. A token is scored in the state of the longest kept suffix.

Sizes: a context must be seen EVIDENCE * sqrt(n) times in n training tokens, so the tree grows with the
root of the corpus: at most sqrt(n) / EVIDENCE contexts a level, their lists 1 / GAMMA words each. It is
counted in Spark, put together on the driver and broadcast; at n = 10^10 (some 50 GB of texts) that is at most
three million contexts a level. Counts are exact sums over all training texts. The words too rare to be listed
are the larger part of the vocabulary: their occurrences meet by word in the shuffle, where they are counted
and scored against their own count, and no such word can be hot.

A word is a run of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; each text has one more
token, its end. Null texts are empty: the end alone. Rows repeat or lack ids without harm: each
row is a text of its own, and a null id trains. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pixelmill.llm.tables import buckets, share, stage
from pixelmill.llm.textarrays import planes, slices, texts_of, unplanes

#: A context's least count as a multiple of the root of the number of training tokens.
EVIDENCE = 0.03
GAMMA = 0.02
LEVELS = 3
DISCOUNT = 0.5
ADD = 0.1
#: The name of a text's end among the words' hashes, and bits for a listable word's number.
END = np.uint64(1)
_BITS = np.uint64(32)
_MERGE_KEYS = 1 << 22


def least_seen(n: int) -> float:
    return max(2.0, EVIDENCE * n**0.5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


@dataclass
class Level:
    """Contexts of one length: their sorted keys, their kept lists and what they leave to shorter ones.

    A context's key is its shorter part's number (its last word's, at the first level) and a word's number.
    """

    keys: np.ndarray
    counts: np.ndarray
    kept: np.ndarray | None = None
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_rest: np.ndarray | None = None


@dataclass
class Tree:
    """Listable words sorted by hash with their training counts, totals, and the levels."""

    words: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    levels: list[Level] = field(default_factory=list)

    @property
    def log_root(self) -> np.ndarray:
        return np.log10(self.counts + ADD) - self.log_total

    @property
    def log_total(self) -> float:
        return float(np.log10(self.n + ADD * (self.v + 1)))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1 if it cannot be listed."""
        return find(self.words, hashes)

    def contexts(self, number: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each token and level, the number of the context before it, or -1.

        `first` marks the first token of each text: no context reaches before it.
        """
        out: list[np.ndarray] = []
        before = np.append(-1, number[:-1]) if len(number) else number
        before = np.where(first, -1, before)
        for depth, level in enumerate(self.levels):
            if depth == 0:
                at = find(level.keys, np.where(before >= 0, before, 0).astype(np.uint64))
                at = np.where(before >= 0, at, -1)
            else:
                earlier = np.append(-1, out[-1][:-1]) if len(number) else number
                ok = (earlier >= 0) & (before >= 0) & ~first
                at = np.where(ok, find(level.keys, pair(np.where(ok, earlier, 0), np.where(ok, before, 0))), -1)
            out.append(at)
        return out

    def log_p(self, number: np.ndarray, contexts: list[np.ndarray], root: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; `root` is its log10 probability without context."""
        total, done = np.zeros(len(number)), np.zeros(len(number), bool)
        for level, context in zip(reversed(self.levels), reversed(contexts), strict=True):
            at = np.flatnonzero(~done & (context >= 0))
            at = at[level.kept[context[at]]] if len(level.keys) else at[:0]
            listed = np.where(number[at] >= 0, find(level.entries, pair(context[at], np.maximum(number[at], 0))), -1)
            hit = listed >= 0
            total[at[hit]] += level.log_p[listed[hit]]
            done[at[hit]] = True
            total[at[~hit]] += level.log_rest[context[at[~hit]]]
        return np.where(done, total, total + root)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in the sorted keys, -1 where they are not."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context.astype(np.uint64) << _BITS | word.astype(np.uint64)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, each token's place among them, each text's first token and number of tokens."""
    texts = texts_of(part.column("text")).lower()
    hashes = np.insert(texts.word_hashes | np.uint64(2), texts.first[1:], END)
    names, which = np.unique(hashes, return_inverse=True)
    size = np.diff(texts.first) + 1
    return names, which, np.cumsum(size) - size, size


class _Sums:
    """Counts by key, merged now and then, for a whole task."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        names, which = np.unique(keys, return_inverse=True)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(which, counts, minlength=len(names)).astype(np.int64))], ["key", "n"])


def _counted(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, n): summed over all training texts, within each task first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for part in slices(batches, "text"):
            sums.add(*keys_of(part))
            if sums.size > _MERGE_KEYS:
                yield sums.merged()
        yield sums.merged()

    return docs.filter("NOT held_out").select("text").mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Tree:
    """The tree of the training rows of `docs` (text, held_out)."""
    spark = docs.sparkSession

    def words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        names, which, _, _ = _tokens(part)
        return names, np.bincount(which, minlength=len(names))

    counts = stage(_counted(docs, words))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    # No rarer word can be listed by a context that is common enough.
    common = counts.filter((F.col("n") >= max(2.0, GAMMA * least_seen(n))) | (F.col("key") == int(END))).toArrow()
    names, times = _sorted(common)
    tree = Tree(names, times, n, v)
    often = times >= least_seen(n)
    often &= names != END
    numbers = np.flatnonzero(often)
    tree.levels.append(Level(numbers.astype(np.uint64), times[numbers]))
    for depth in range(LEVELS):
        held = share(spark, tree)

        def pairs(part: pa.RecordBatch, held=held, depth=depth) -> tuple[np.ndarray, np.ndarray]:
            names, which, first, _ = _tokens(part)
            number = held().numbers(names)[which]
            start = np.zeros(len(number), bool)
            start[first] = True
            context = held().contexts(number, start)[depth]
            at = np.flatnonzero((context >= 0) & (number >= 0))
            return np.unique(pair(context[at], number[at]), return_counts=True)

        # Lists and longer contexts need no rarer pair than this.
        found = _counted(docs, pairs).filter(F.col("n") >= max(2.0, GAMMA * least_seen(n))).toArrow()
        keys, times = _sorted(found)
        _keep(tree, depth, keys, times)
        longer = (times >= least_seen(n)) & (tree.words[(keys & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)] != END)
        if depth + 1 < LEVELS:
            tree.levels.append(Level(keys[longer], times[longer]))
    return tree


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _keep(tree: Tree, depth: int, keys: np.ndarray, times: np.ndarray) -> None:
    """Lists the next words of a level's contexts and keeps the contexts that pass the divergence test."""
    level = tree.levels[depth]
    context, word = (keys >> _BITS).astype(np.int64), (keys & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
    share = times / level.counts[context]
    use = share >= GAMMA
    keys, context, word, times, share = keys[use], context[use], word[use], times[use], share[use]
    # What the suffix, one word shorter at the far end, predicts for the same word.
    suffix = [np.full(len(keys), -1) for _ in range(depth)]
    if depth:
        far = context
        chain = []
        for back in range(depth, 0, -1):  # words of the context, the latest first
            key = tree.levels[back].keys[far]
            chain.append((key & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64))
            far = (key >> _BITS).astype(np.int64)
        for short in range(depth):  # the suffix of short + 1 words, from its first word on
            at = find(tree.levels[0].keys, chain[short].astype(np.uint64))
            for step in range(1, short + 1):
                known = at >= 0
                at = np.where(known, find(tree.levels[step].keys, pair(np.where(known, at, 0), chain[short - step])), -1)
            suffix[short] = at
    shorter = Tree(tree.words, tree.counts, tree.n, tree.v, tree.levels[:depth])
    base = 10 ** shorter.log_p(word, suffix, tree.log_root[word])
    m = len(level.keys)
    total = lambda x: np.bincount(context, x, minlength=m)
    rest, base_rest = np.maximum(1 - total(share), 1e-9), np.maximum(1 - total(base), 1e-9)
    divergence = total(share * np.log(share / base)) + rest * np.log(rest / base_rest)
    level.kept = level.counts * divergence > 0.5 * np.bincount(context, minlength=m) * np.log(np.maximum(level.counts, 2))
    level.kept &= np.bincount(context, minlength=m) > 0
    own = level.kept[context]
    p = np.maximum(times - DISCOUNT, 1e-3) / level.counts[context]
    left = np.maximum(1 - np.bincount(context, p, minlength=m), 1e-9)
    level.entries, level.log_p, level.log_rest = keys[own], np.log10(p[own]), np.log10(left / base_rest)


def score(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row per row of `docs` (doc_id, text, held_out): n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    held, n_buckets = share(spark, tree), max(1, buckets(spark) // 2)
    key = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([
        T.StructField("row", T.LongType()), key,
        *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base double, model double, bucket int, words binary, rows binary, trains binary"),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text without its rare words, and now and then a row per bucket with the rare words since."""
        tree = held()
        log_root, log_total, log_count, known = tree.log_root, tree.log_total, np.log10(tree.counts + ADD), tree.counts > 0
        row = TaskContext.get().partitionId() << 40
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for part in slices(batches, "text"):
            names, which, first, size = _tokens(part)
            number = tree.numbers(names)
            numbers = number[which]
            start = np.zeros(len(which), bool)
            start[first] = True
            listable = numbers >= 0
            root = np.where(listable, log_root[numbers] if len(log_root) else 0.0, -log_total)
            model = tree.log_p(numbers, tree.contexts(numbers, start), root)
            sums = lambda x: np.add.reduceat(x, first)
            own = np.arange(row, row + part.num_rows)
            row += part.num_rows
            at = np.flatnonzero(~listable)
            text = np.repeat(np.arange(part.num_rows), size)[at]
            trains = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            rare.append((names[which[at]], own[text], trains[text]))
            waiting += len(at)
            none = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), part.column("doc_id"), part.column("held_out"), pa.array(size.astype(np.int64)), pa.array(sums((listable & known[numbers] if len(known) else listable).astype(np.int64))), pa.array(sums(np.where(listable, log_count[numbers] if len(log_count) else 0.0, 0.0)) - size * log_total), pa.array(sums(model)), pa.nulls(part.num_rows, pa.int32()), none, none, none],
                schema.names,
            )
            if waiting > _MERGE_KEYS // 2:
                yield _blocks(rare, n_buckets, schema.names, key)
                rare, waiting = [], 0
        if waiting:
            yield _blocks(rare, n_buckets, schema.names, key)

    def _blocks(rare: list, n_buckets: int, names: list[str], key: T.StructField) -> pa.RecordBatch:
        word, row, trains = (np.concatenate(x) for x in zip(*rare, strict=True))
        bucket = (word >> np.uint64(8)) % np.uint64(n_buckets)
        order = np.lexsort((row, word, bucket))
        word, row, trains = word[order], row[order], trains[order]
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        parts = [slice(cut[b], cut[b + 1]) for b in some]
        packed = [
            [planes(np.diff(word[p], prepend=np.uint64(0))) for p in parts],
            [planes(row[p]) for p in parts],
            [np.packbits(trains[p]).tobytes() for p in parts],
        ]
        n = len(some)
        from pyspark.sql.pandas.types import to_arrow_type

        blank = [pa.nulls(n, t) for t in (pa.int64(), to_arrow_type(key.dataType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*blank, pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each task that read texts, the sums over their rare words of a bucket: one row, packed."""
        now, blocks = None, []

        def done() -> pa.RecordBatch:
            word, row, trains = (np.concatenate(x) for x in zip(*blocks, strict=True))
            names, which = np.unique(word, return_inverse=True)
            count = np.bincount(which, trains, minlength=len(names))
            texts, place = np.unique(row, return_inverse=True)
            known, base = np.bincount(place, count[which] > 0).astype(np.int64), np.bincount(place, np.log10(count + ADD)[which])
            task = texts >> 40
            first = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            parts = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(texts)), strict=True)]
            packed = ([planes(x[p]) for p in parts] for x in (texts, known, base))
            return pa.RecordBatch.from_arrays([pa.array(task[first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["task", "rows", "n_known", "base"])

        for batch in batches:
            for bucket, words, row, trains in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and blocks:
                    yield done()
                    blocks = []
                now = bucket
                word = np.cumsum(unplanes(words, np.uint64), dtype=np.uint64)
                blocks.append((word, unplanes(row, np.int64), np.unpackbits(np.frombuffer(trains, np.uint8))[: len(word)]))
        if blocks:
            yield done()

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each text over all buckets, for the texts of one task after another."""
        now, blocks = None, []

        def done() -> pa.RecordBatch:
            row, known, base = (np.concatenate(x) for x in zip(*blocks, strict=True))
            texts, place = np.unique(row, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.bincount(place, known).astype(np.int64)), pa.array(np.bincount(place, base))], ["row", "more_known", "more"])

        for batch in batches:
            for task, row, known, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now and blocks:
                    yield done()
                    blocks = []
                now = task
                blocks.append((unplanes(row, np.int64), unplanes(known, np.int64), unplanes(base, np.float64)))
        if blocks:
            yield done()

    both = stage(docs.select("doc_id", "text", "held_out").mapInArrow(rows, schema))
    texts = both.filter("row IS NOT NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model")
    rare = (
        both.filter("row IS NULL").select("bucket", "words", "rows", "trains").repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(meet, "task int, rows binary, n_known binary, base binary").repartition("task").sortWithinPartitions("task")
        .mapInArrow(by_text, "row long, more_known long, more double")
    )
    more = F.coalesce("more", F.lit(0.0))
    return texts.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, fit(docs))
