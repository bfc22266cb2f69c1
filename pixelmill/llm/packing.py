"""Packing of tokenised documents into sequences of a fixed length, by linear grouping.

How pieces are packed depends on their lengths alone, and there are no more lengths than the
capacity. So the plan is made from the histogram, whatever the corpus:

1. Large lengths are rounded up within groups of equal numbers of pieces.
2. Configurations of these few sizes fill whole runs of sequences: the largest size left with the
   others that fill the rest best.
3. Actual pieces take the rounded ones' places, so the room left is that of the actual lengths.
4. Small lengths, largest first, go where they leave the least room.

The plan says for runs of pieces of a length, by rank, which sequence and offset they take. Ranks
come from counts per task and length, so no step sorts or gathers the pieces.

Null texts are empty: the end id alone. Repeated rows and null ids are documents of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pixelmill.llm.encoding import WordIds, word_encoder
from pixelmill.llm.tables import share, stage
from pixelmill.llm.textarrays import slices, texts_of

CAPACITY = 2048
GROUPS = 512
#: Lengths from here on are small: they fill what the configurations leave.
SMALL = 768


@dataclass
class Run:
    """`n` sequences from `first` on, filled alike up to `filled`."""

    first: int
    n: int
    filled: int


class Plan:
    """Where the pieces of each length go: runs of ranks, each to a run of sequences."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.sequences = capacity, 0
        self.taken = np.zeros(capacity + 1, np.int64)
        self.rows: list[tuple[int, int, int, int]] = []
        self.open: list[list[Run]] = [[] for _ in range(capacity + 1)]
        self._configure(self._grouped(counts, groups, small))
        for length in range(min(small, capacity), 0, -1):
            self._best_fit(length, int(counts[length]))
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = rows.T

    def _place(self, length: int, run: Run) -> None:
        """One piece of this length for each sequence of the run."""
        self.rows.append((length, int(self.taken[length]), run.first, run.filled))
        self.taken[length] += run.n
        run.filled += length

    def _start(self, n: int) -> Run:
        run = Run(self.sequences, n, 0)
        self.sequences += n
        return run

    @staticmethod
    def _grouped(counts: np.ndarray, groups: int, small: int) -> list[list[list[int]]]:
        """Groups of [length, pieces] with about equal numbers of pieces, largest lengths first."""
        lengths = [n for n in range(len(counts) - 1, small, -1) if counts[n]]
        each = max(1, -(-int(sum(counts[n] for n in lengths)) // groups))
        out, room = [], 0
        for n in lengths:
            left = int(counts[n])
            while left:
                if not room:
                    out.append([])
                    room = each
                some = min(left, room)
                out[-1].append([n, some])
                left, room = left - some, room - some
        return out

    def _configure(self, grouped: list[list[list[int]]]) -> None:
        sizes = [g[0][0] for g in grouped]
        left = [sum(n for _, n in g) for g in grouped]
        for k in range(len(grouped)):
            while left[k]:
                parts = self._complement(sizes, left, k)
                times = min(left[g] // parts.count(g) for g in set(parts))
                for g in parts:
                    left[g] -= times
                self._substitute([grouped[g] for g in parts], times)

    def _complement(self, sizes: list[int], left: list[int], k: int) -> list[int]:
        """Group k and the groups that best fill the room beside it, as far as there are pieces."""
        room = self.capacity - sizes[k]
        came = np.full(room + 1, -1, np.int64)  # the group that completes a sum
        came[0] = len(sizes)
        for g in range(k, len(sizes)):
            for _ in range(min(left[g] - (g == k), room // sizes[g])):
                new = np.flatnonzero((came[sizes[g] :] < 0) & (came[: room + 1 - sizes[g]] >= 0)) + sizes[g]
                if not len(new):
                    break
                came[new] = g
        at, parts = int(np.flatnonzero(came >= 0)[-1]), [k]
        while at:
            parts.append(int(came[at]))
            at -= sizes[came[at]]
        return parts if all(parts.count(g) <= left[g] for g in set(parts)) else [k]

    def _substitute(self, groups: list[list[list[int]]], times: int) -> None:
        """Actual pieces for `times` sequences with one piece of each group."""
        def head(g: list[list[int]]) -> list[int]:
            while not g[0][1]:
                g.pop(0)
            return g[0]

        while times:
            # As many alike as the lengths in front allow; one if a group gives several and its front has too few.
            some = min(times, *(max(1, head(g)[1] // sum(g is x for x in groups)) for g in groups))
            run = self._start(some)
            for g in groups:
                front = head(g)
                front[1] -= some
                self._place(front[0], run)
            self.open[self.capacity - run.filled].append(run)
            times -= some

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            room = next((r for r in range(length, self.capacity + 1) if self.open[r]), None)
            if room is None:
                run = self._start(-(-n // (self.capacity // length)))
            else:
                run = self.open[room].pop()
            if run.n > n:
                self.open[self.capacity - run.filled].append(Run(run.first + n, run.n - n, run.filled))
                run.n = n
            n -= run.n
            self._place(length, run)
            self.open[self.capacity - run.filled].append(run)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        key = lambda n, r: (n.astype(np.int64) << 48) + r
        row = np.searchsorted(key(self.length, self.rank), key(length, rank), "right") - 1
        return self.sequence[row] + rank - self.rank[row], self.offset[row]


def pieces(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): documents cut to the capacity.

    nth counts the pieces of equal length within a task. `with_ids` adds the ids themselves.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        ids_of = WordIds(encode)
        for part in slices(batches, "text", 1 << 20):
            ids, edges = ids_of(texts_of(part.column(1)), end)
            many = -(-np.diff(edges) // capacity)
            doc = np.repeat(np.arange(part.num_rows), many)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = number * capacity
            length = np.minimum(np.diff(edges)[doc] - start, capacity)
            first = edges[:-1][doc] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            begin = np.searchsorted(length[order], length[order])
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - begin + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            out = [part.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(first, edges[-1]).astype(np.int32)), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def pack(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stage(pieces(docs, encode, end, capacity, with_ids))
    counts = stage(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        histogram[row["length"]] = row["n"]
    plan = share(docs.sparkSession, Plan(histogram, capacity))  # its size depends on the capacity alone
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).hint("merge"), ["task", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = T.StructType([*(cut.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan().find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.withColumn("rank", F.col("base") + F.col("nth")).select(*kept, "rank").mapInArrow(rows, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_encoder(public_tokenizers.path("word_bpe_49k.json")))
