"""Hard negatives by threshold joins over an inverted index of vector prefixes.

An anchor's positives are its best rows of the same label; each opens a window of scores, from
`low` to `high` per cent of its own, and the best rows of other labels inside it are the
negatives. Both searches are the same exact join, of anchors with a threshold each against all rows:

1. Anchors and rows are dealt into chunks and blocks of bounded size, and each chunk meets each block.
2. Inside such a meeting the components are put in order of their weight. A row is listed under the first
   ones only: from where its remaining norm times an anchor's norm stays below every threshold, its
   components are left out of the index. Lists are added up in groups of components, and rows whose
   partial scores plus the remaining norms reach no threshold are dropped on the way.
3. Thresholds start high. Anchors whose windows (or lists of positives) are full are done; the others
   come again with a lower one, until the floor of their windows, below which nothing counts.

So a threshold only decides how soon an anchor is done. Components are multiplied by `scale` and
floored; scores are whole numbers, higher ones first, ties by the smaller id.

Rows with a null id, label or vector, or with null or non-finite components, take no part. Equal
rows are one row; rows that share an id but not the rest are each scored with what they
have. Vectors of different lengths never meet. A positive whose score is negative has an empty window.
An empty table gives an empty result. A candidate's score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pixelmill.llm.tables import buckets, stage

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Components of a block or chunk at most: 32 MB.
BLOCK_VALUES = 1 << 22
#: Fewer rows than this make no block of their own.
BLOCK_LEAST = 512
#: Partial scores held at once.
SCORES = 1 << 21
#: Components whose lists are added up before rows are dropped.
STEP = 8
#: Rounds of thresholds; the last one is the floor.
ROUNDS = 3
_FLOOR = -1e308
_HITS = "anchor_id long, vec_id long, score long"


def whole_doubles(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.when(vector.isNotNull() & ~bad, F.transform(vector, whole))


def _rest(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from component k on, for every k and the end."""
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1])
    return out


def _exact(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of rows with rows."""
    if safe:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    found = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q.tolist(), x.tolist(), strict=True)]
    if any(abs(s) >= 1 << 63 for s in found):
        raise OverflowError("an inner product does not fit into 64 bits")
    return np.array(found, np.int64)


def threshold_join(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ask, row, score) of all pairs whose inner product is `least[ask]` or more, in parts by ask."""
    size = x.shape[1]
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * size < 2**53
    order = np.argsort(-(x * x).sum(0), kind="stable")
    q, x = q[:, order], x[:, order]
    q_rest, x_rest = _rest(q), _rest(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(q_rest[:, 0] > 0, least / q_rest[:, 0], np.where(least <= 0, -np.inf, np.inf))
    asks = np.argsort(ratio, kind="stable")
    per = max(1, SCORES // max(1, len(x)))
    for start in range(0, len(asks), per):
        own = asks[start : start + per]
        floor = ratio[own[0]] * (1 - 1e-9 * np.sign(ratio[own[0]]))
        # How many components of each row are listed, in whole groups.
        listed = np.full(len(x), size) if floor <= 0 else np.minimum(-(-(x_rest[:, :-1] >= floor).sum(1) // STEP) * STEP, size)
        rows = np.argsort(-listed, kind="stable")
        rows = rows[listed[rows] > 0] if size else rows
        lists, partial = x[rows], np.zeros((len(own), len(rows)))
        bar = least[own][:, None]

        def ceiling(upto: np.ndarray, n: int) -> np.ndarray:
            """What the first n rows can reach, with all that follows component `upto`."""
            more = q_rest[own][:, upto] * x_rest[rows[:n], upto] if np.ndim(upto) else q_rest[own, upto][:, None] * x_rest[rows[:n], upto]
            return partial[:, :n] + more + 1e-9 * q_rest[own, 0][:, None] * x_rest[rows[:n], 0] >= bar

        for a in range(0, size, STEP):
            n = int(np.searchsorted(-listed[rows], -a, "left"))
            if not n:
                break
            b = min(size, a + STEP)
            partial[:, :n] += q[own, a:b] @ lists[:n, a:b].T
            alive = ceiling(b, n).any(0)
            if alive.mean() < 0.75:
                keep = np.concatenate([np.flatnonzero(alive), np.arange(n, len(rows))])
                rows, lists, partial = rows[keep], lists[keep], partial[:, keep]
        at, place = np.nonzero(ceiling(listed[rows], len(rows)))
        ask, row = own[at], rows[place]
        if safe:  # whole sums are exact; the others still lack what was not listed
            score = partial[at, place].astype(np.int64)
            lack = np.flatnonzero(listed[row] < size)
        else:
            score, lack = np.zeros(len(ask), np.int64), np.arange(len(ask))
        for a in range(0, len(lack), SCORES // max(size, 1) + 1):
            part = lack[a : a + SCORES // max(size, 1) + 1]
            score[part] = _exact(q[ask[part]], x[row[part]], safe)
        good = score >= least[ask]
        yield ask[good], row[good], score[good]


def _best(ask: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which hits are among the k best of their ask; equal hits count once."""
    order = np.lexsort((vec, -score, ask))
    a, v, s = ask[order], vec[order], score[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    order, a = order[new], a[new]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _hits(asks: pa.Table, ask: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table([asks.column("anchor_id").combine_chunks().take(pa.array(ask)), pa.array(vec), pa.array(score)], ["anchor_id", "vec_id", "score"])


def _met(rows: DataFrame, asks: DataFrame, keys: list[str], solve) -> DataFrame:
    """Hits of every block of rows with every chunk of asks that has the same keys."""
    spark = rows.sparkSession
    most = F.greatest(F.lit(1), F.lit(BLOCK_VALUES) / F.greatest("size", F.lit(1)))
    per_block = F.least(most, F.greatest(F.lit(BLOCK_LEAST), F.col("n") / buckets(spark)))
    dealt = (
        rows.groupBy(*keys).agg(F.count("*").alias("n")).join(asks.groupBy(*keys).agg(F.count("*").alias("m")), keys)
        .select(*keys, F.ceil(F.col("n") / per_block).cast("int").alias("blocks"), F.ceil(F.col("m") / most).cast("int").alias("chunks"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(dealt, keys).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).withColumn("chunk", every("chunks")).drop("blocks", "chunks")
    right = asks.join(dealt, keys).withColumn("chunk", F.pmod(F.xxhash64("anchor_id", "v"), F.col("chunks")).cast("int")).withColumn("block", every("blocks")).drop("blocks", "chunks")
    group = [*keys, "chunk", "block"]

    def both(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            empty = np.zeros(0, np.int64)
            return _hits(q, empty, empty, empty)
        return solve(x, q)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(both, _HITS).distinct()


def _start(n: Column, wanted: int) -> Column:
    """Where the best `wanted` of n normal scores begin, in standard deviations."""
    tail = F.log(F.greatest(n / wanted, F.lit(4.0)))
    return F.sqrt(F.greatest(2 * tail - F.log(2 * tail) - 1.84, F.lit(0.1)))


def _positives(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the k best other rows of the anchor's label."""
    spread = rows.groupBy("label", "size").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("far"))
    start = F.col("norm") * F.col("far") / F.sqrt(F.greatest("size", F.lit(1))) * _start(F.col("n"), 4 * k)
    open_ = asks.join(spread, ["label", "size"]).withColumn("start", start).drop("n", "far")

    def solve(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, own = x.column("vec_id").to_numpy(), q.column("anchor_id").to_numpy()
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for ask, row, score in threshold_join(_matrix(q), _matrix(x), q.column("least").to_numpy()):
            other = ids[row] != own[ask]
            ask, vec, score = ask[other], ids[row][other], score[other]
            best = _best(ask, vec, score, k)
            for column, values in zip(out, (ask[best], vec[best], score[best])):
                column.append(values)
        return _hits(q, *(np.concatenate(c) for c in out))

    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    done = []
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        now = open_.withColumn("least", F.lit(_FLOOR) if last else F.col("start") / 2**turn)
        best = stage(_met(rows, now, ["label", "size"], solve).withColumn("rank", rank).filter(F.col("rank") <= k))
        full = best.filter(F.col("rank") == k).select("anchor_id")
        done.append(best if last else best.join(full, "anchor_id", "left_semi"))
        if last or (open_ := stage(open_.join(full, "anchor_id", "left_anti"))).isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more.select(*out.columns))
    return stage(out.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label)."""
    v = whole_doubles(F.col("embedding"), scale)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x))
    rows = stage(
        vectors.select("vec_id", "label", v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct()
        .withColumn("size", F.size("v")).withColumn("norm", norm)
    )
    asks = stage(rows.filter("asks").select(F.col("vec_id").alias("anchor_id"), "label", "v", "size", "norm"))
    rows = rows.drop("asks")
    found = _positives(rows, asks, positives)
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = stage(
        found.filter("positive_score >= 0")
        .withColumn("lo", F.ceil(score * low / 100).cast("long")).withColumn("hi", F.floor(score * high / 100).cast("long")).filter("lo <= hi")
    )
    spread = rows.groupBy("size").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("far"))
    per_anchor = windows.groupBy("anchor_id").agg(
        F.min("lo").alias("floor"), F.min("hi").alias("top"), F.collect_list(F.struct("lo", "hi")).alias("windows")  # `positives` at most
    )
    start = F.least(
        F.col("norm") * F.col("far") / F.sqrt(F.greatest("size", F.lit(1))) * _start(F.col("n"), 4 * negatives),
        F.col("top") - (F.col("top") - F.col("floor")) / 10,
    )
    open_ = asks.join(per_anchor, "anchor_id").join(spread, "size").withColumn("start", F.greatest(start, "floor")).drop("n", "far", "top")

    def solve(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, labels = x.column("vec_id").to_numpy(), np.asarray(x.column("label").to_pylist(), object)
        own = np.asarray(q.column("label").to_pylist(), object)
        bounds = q.column("windows").combine_chunks()
        edges, lo, hi = bounds.offsets.to_numpy(), bounds.values.field("lo").to_numpy(), bounds.values.field("hi").to_numpy()
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for ask, row, score in threshold_join(_matrix(q), _matrix(x), q.column("least").to_numpy()):
            other = labels[row] != own[ask]
            ask, vec, score = ask[other], ids[row][other], score[other]
            keep = np.zeros(len(ask), bool)
            for w in range(int(np.diff(edges).max())):
                at = edges[ask] + w
                there = at < edges[ask + 1]
                at = np.where(there, at, 0)
                inside = np.flatnonzero(there & (lo[at] <= score) & (score <= hi[at]))
                keep[inside[_best(ask[inside], vec[inside], score[inside], negatives)]] = True
            for column, values in zip(out, (ask[keep], vec[keep], score[keep])):
                column.append(values)
        return _hits(q, *(np.concatenate(c) for c in out))

    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "vec_id"))
    done = []
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        # From the start half way down to the floor, and then to the floor.
        now = open_.withColumn("least", F.col("floor") + (F.col("start") - F.col("floor")) * (0 if last else 0.5**turn))
        hits = _met(rows, now, ["size"], solve)
        best = stage(
            hits.join(windows, "anchor_id").filter("lo <= score AND score <= hi").withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )
        if last:
            done.append(best)
            break
        counts = best.groupBy("anchor_id", "positive_id", "positive_score").agg(F.count("*").alias("got"))
        wanting = (
            windows.join(now.select("anchor_id", "least"), "anchor_id").join(counts, ["anchor_id", "positive_id", "positive_score"], "left")
            .filter((F.coalesce("got", F.lit(0)) < negatives) & (F.col("least") > F.col("lo"))).select("anchor_id").distinct()
        )
        open_ = stage(open_.join(wanting, "anchor_id", "left_semi"))
        done.append(best.join(open_.select("anchor_id").distinct(), "anchor_id", "left_anti"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_inner_product(a.v, d.v)::BIGINT AS score
  FROM v a, v d WHERE a.vec_id % 100 = 0 AND d.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
