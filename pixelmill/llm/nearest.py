"""Exact top-k by inner product as a Voronoi join.

Pivots divide queries and data into cells. Two numbers of each cell, its radius around the pivot
and its count, bound the products between any query cell G (pivot p, radius s) and data cell H
(pivot c, radius r): p.c within |p| r + s |c| + s r. The best cells that together hold k + 1 vectors
give G a score that its k-th hit cannot fall below; a vector x goes to G only if p.x + s |x|
can reach that. Each query cell is then solved on its own, in blocks of data rows.

Vectors that are null or have null or non-finite components take no part, and null ids neither.
Only vectors of one length can be compared. Rows with equal id and vector are one row. Ties go to
the smaller id. An empty table gives an empty result. Components are multiplied by `scale` and
floored; a component or an inner product that does not fit into 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pixelmill.llm.tables import stage

PIVOTS = 16
#: Vectors the pivots are drawn from, always the same ones.
SAMPLE_ROWS = 2_000
BLOCK_ROWS = 65_536
QUERY_ROWS = 16_384
_SOLVE_ROWS = 4_096


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) for each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long"))

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, whole))


@dataclass(frozen=True)
class Cells:
    """Pivots by cell number; a vector of a length that no pivot has is in cell -1 - length, around zero."""

    pivots: tuple[np.ndarray, ...]

    def assign(self, vector: np.ndarray) -> tuple[int, float]:
        """The nearest pivot's cell, and the distance."""
        own = [(float(np.linalg.norm(vector - p)), k) for k, p in enumerate(self.pivots) if len(p) == len(vector)]
        d, k = min(own, default=(float(np.linalg.norm(vector)), -1 - len(vector)))
        return k, d

    def pivot(self, cell: int) -> np.ndarray:
        return self.pivots[cell] if cell >= 0 else np.zeros(-1 - cell)


def choose_pivots(sample: list[np.ndarray], n: int = PIVOTS, rounds: int = 5) -> Cells:
    """Means of a bounded sample's groups, per length of vector."""
    out: list[np.ndarray] = []
    for size in sorted({len(v) for v in sample}):
        points = np.array([v for v in sample if len(v) == size], float)
        if not size:
            continue
        centers = np.unique(points, axis=0)
        centers = centers[:: max(1, len(centers) // n)][:n]
        for _ in range(rounds):
            near = ((points[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
            centers = np.stack([points[near == k].mean(0) if (near == k).any() else centers[k] for k in range(len(centers))])
        out.extend(centers)
    return Cells(tuple(out))


def _assigned(vectors: DataFrame, cells: Cells) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells.assign(np.array(v.as_py(), float)) for v in batch.column("v")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c for c, _ in found], pa.int32()), pa.array([d for _, d in found], pa.float64())],
                ["vec_id", "v", "is_query", "cell", "distance"],
            )

    return vectors.mapInArrow(rows, "vec_id long, v array<long>, is_query boolean, cell int, distance double")


def lower_bounds(queries: dict[int, float], data: dict[int, tuple[float, int]], cells: Cells, k: int) -> dict[int, float]:
    """For each query cell with its radius, a score its queries' k-th hits reach at least; -inf if too few vectors."""
    out = {}
    for g, s in queries.items():
        p = cells.pivot(g)
        lows = []
        for h, (r, n) in data.items():
            c = cells.pivot(h)
            if len(c) == len(p):
                lows.append((p @ c - np.linalg.norm(p) * r - s * np.linalg.norm(c) - s * r, n))
        held, out[g] = 0, -np.inf
        for low, n in sorted(lows, reverse=True):
            held += n
            if held > k:  # one of them may be the query itself
                out[g] = float(low - 1e-9 * abs(low) - 1)
                break
    return out


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties to the smaller id, repeated rows once."""
    order = np.lexsort((vec, -score, query))
    query, score, vec = query[order], score[order], vec[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (vec[1:] != vec[:-1])
    query, score, vec = query[new], score[new], vec[new]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], score[rank < k], vec[rank < k]


class _Group:
    """The queries of one group and their best hits so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors = k, [], []
        self.hits = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.matrix = None

    def data(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.ids or not len(ids):
            return
        if self.matrix is None:
            self.matrix, self.own = np.stack(self.vectors), np.array(self.ids, np.int64)
        top = float(np.abs(self.matrix).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
        if top < 2**53:  # sums of products are whole numbers that doubles hold exactly
            score = (self.matrix.astype(float) @ x.astype(float).T).astype(np.int64)
        elif top < 2**63:
            score = self.matrix @ x.T
        else:  # Python's own numbers have room
            exact = self.matrix.astype(object) @ x.T.astype(object)
            exact[ids[None, :] == self.own[:, None]] = 0
            if any(abs(s) >= 1 << 63 for s in exact.ravel()):
                raise OverflowError("an inner product does not fit into 64 bits")
            score = exact.astype(np.int64)
        score[ids[None, :] == self.own[:, None]] = np.iinfo(np.int64).min
        query, score_now, _ = self.hits
        worst = np.full(len(self.own), np.iinfo(np.int64).min)
        full = np.bincount(query, minlength=len(self.own)) == self.k
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else query
        worst[query[last]] = np.where(full[query[last]], score_now[last], worst[query[last]])
        if score.shape[1] > self.k + 1:
            worst = np.maximum(worst, np.partition(score, -self.k - 1, axis=1)[:, -self.k - 1])
        at, which = np.nonzero((score >= worst[:, None]) & (ids[None, :] != self.own[:, None]))
        self.hits = _best(np.append(query, at), np.append(score_now, score[at, which]), np.append(self.hits[2], ids[which]), self.k)

    def result(self) -> pa.RecordBatch:
        query, score, vec = self.hits
        own = np.array(self.ids, np.int64)[query] if len(query) else query
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) for which `is_query` holds, against all other rows."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    sample = v.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    cells = choose_pivots([np.array(r["v"], float) for r in sample])
    placed = stage(_assigned(v, cells))
    # One row per cell: PIVOTS per length of vector at most.
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r"), F.max(F.when(F.col("is_query"), F.col("distance"))).alias("s"), F.count(F.when(F.col("is_query"), 1)).alias("m")).collect()
    radius = {r["cell"]: r["s"] for r in summary if r["m"]}
    reach = lower_bounds(radius, {r["cell"]: (r["r"], r["n"]) for r in summary}, cells, k)
    blocks = max(1, -(-sum(r["n"] for r in summary) // BLOCK_ROWS))
    chunks = {r["cell"]: -(-r["m"] // QUERY_ROWS) for r in summary if r["m"]}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries go to all blocks of their group, data to the groups they can matter to."""
        groups = sorted(radius)
        pivot = {g: cells.pivot(g) for g in groups}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            row = []
            for i, (vec, x, asks, cell) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = np.array(x.as_py(), float)
                size = float(np.linalg.norm(x))
                slack = 1 + 1e-9 * size * size
                targets = [(g, c, vec % blocks, False) for g in groups if len(pivot[g]) == len(x) and pivot[g] @ x + radius[g] * size + slack >= reach[g] for c in range(chunks[g])]
                if asks:
                    targets += [(cell, hash(vec) % chunks[cell], b, True) for b in range(blocks)]
                row += [i] * len(targets)
                for column, values in zip(out, zip(*targets), strict=False):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), batch.column(0).take(pa.array(row, pa.int32())), batch.column(1).take(pa.array(row, pa.int32()))],
                ["g", "chunk", "block", "asks", "vec_id", "v"],
            )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, _Group(k)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a][:3] != now:
                    yield group.result()
                    now, group = keys[a][:3], _Group(k)
                for start in range(a, b, _SOLVE_ROWS):
                    part = batch.slice(start, min(b - start, _SOLVE_ROWS))
                    ids = part.column("vec_id").to_numpy()
                    x = part.column("v").flatten().to_numpy().reshape(len(ids), -1)
                    if keys[a][3]:
                        group.ids.extend(ids.tolist())
                        group.vectors.extend(x)
                    else:
                        group.data(ids, x)
        yield group.result()

    sent = placed.mapInArrow(rows, "g int, chunk int, block long, asks boolean, vec_id long, v array<long>")
    met = sent.repartition("g", "chunk", "block").sortWithinPartitions("g", "chunk", "block", F.desc("asks"))
    hits = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
