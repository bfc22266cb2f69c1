"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

1. Equal vectors are one class, whose smallest id stands for it.
2. A vector is turned by a fixed rotation, and for each of several product codes its components
   are dealt anew into 3 parts. Each part has a code of B random directions, and a filter is one
   direction of each part: B^3 filters from 3 * B inner products. A vector passes a filter whose direction
   it exceeds `alpha` with. List decoding finds these filters part by part and leaves a choice as soon as
   the best that can follow falls short.
3. Vectors are joined on filters. Filters passed by one class alone go before any vector moves.
   Those that share one are compared by cosine in double precision. Each pair counts in the
   least filter it shares, so a group yields one count per member and links that join what belongs
   together, never all its pairs; a large group is split into blocks that meet two by two.

`alpha`, B and the number of codes follow from the number of rows and the length of the vectors: a
vector passes about one filter of each code, and meets a sixteenth of an unrelated vector there. Filters of one
code depend on each other, so more pairs are missed than MISS says; the README has measured rates. What
is linked always reaches the threshold.

Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor do
rows with a null id; they stay as components of their own (null for a null id). Only vectors of one
length are compared. Rows with equal id and vector are one vector; rows that share an id but not the
vector are vectors of one component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelmill.llm.graph import components
from pixelmill.llm.tables import stage
from pixelmill.llm.textarrays import Memo

COSINE = 0.9
#: How likely a pair at the threshold passes no filter together, were all filters independent.
MISS = 1e-5
#: Classes that an unrelated vector meets in a filter, on average.
CROWD = 1 / 16
PARTS = 3
#: In few dimensions related vectors are common anyway; a higher threshold would part them.
ALPHA_MOST = 0.75
#: Shorter vectors get zeros up to this length, so that parts have some components.
LEAST_SIZE = 8
#: Members of a filter that are compared with as many others in one group.
BLOCK = 1024
_SEED = 20_240_817
_SIZE_BITS = 22
_DECODE_ROWS = 512


@dataclass(frozen=True)
class Plan:
    """Filter codes for vectors of one length: number of codes, parts, directions per part, threshold."""

    turns: int
    parts: int
    code: int
    alpha: float


def _tails(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products t with a random direction, and the probability of t or more."""
    t = np.linspace(-1, 1, 200_001)
    mass = (1 - t * t) ** (max(size - 3, 0) / 2)
    tail = np.cumsum(mass[::-1])[::-1]
    return t, tail / tail[0]


def plan(rows: int, size: int, cosine: float = COSINE, miss: float = MISS) -> Plan:
    """The codes for `rows` vectors of `size` components, LEAST_SIZE or more."""
    t, tail = _tails(size)
    one = max(CROWD / max(rows, 1), float(np.interp(ALPHA_MOST, t, tail)))
    alpha = float(t[np.searchsorted(-tail, -one)])
    # Given that one vector passes, the chance that its partner at the threshold does, too.
    own = np.linspace(alpha, 1, 2_000)[:-1]
    weight = (1 - own * own) ** (max(size - 3, 0) / 2)
    u, beyond = _tails(max(size - 1, 2))
    need = (alpha - cosine * own) / np.sqrt((1 - cosine**2) * (1 - own * own))
    both = float((np.interp(need, u, beyond, left=1.0, right=0.0) * weight).sum() / weight.sum())
    return Plan(int(np.ceil(-np.log(miss) / both)), PARTS, int(np.ceil(one ** (-1 / PARTS))), alpha)


_CODES = Memo()


def _codes(how: Plan, size: int) -> tuple[np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """A rotation, and for each code and part which components it has and its directions; the same in every task."""
    if (how, size) not in _CODES:
        rng = np.random.default_rng(_SEED + size)
        turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
        codes = []
        for _ in range(how.turns):
            codes.append([])
            for own in np.array_split(rng.permutation(size), how.parts):
                c = rng.standard_normal((len(own), how.code))
                codes[-1].append((own, c / np.linalg.norm(c, axis=0) / np.sqrt(how.parts)))
        _CODES[how, size] = turn, codes
    return _CODES[how, size]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; components are divided by the largest first, so none overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_decode(x: np.ndarray, how: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter whose direction a unit vector exceeds alpha with."""
    turn, codes = _codes(how, max(x.shape[1], LEAST_SIZE))
    x = x @ turn[: x.shape[1]]
    rows, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, parts in enumerate(codes):
        scores = [x[:, own] @ c for own, c in parts]
        # The most that the parts after each one can add.
        after = np.cumsum([s.max(1) for s in scores[::-1]], 0)[::-1]
        row, name, so_far = np.arange(len(x)), np.full(len(x), number, np.int64), np.zeros(len(x))
        for k, s in enumerate(scores):
            open_ = so_far + after[k][row] >= how.alpha
            row, name, so_far = row[open_], name[open_], so_far[open_]
            reached = so_far[:, None] + s[row]
            at, code = np.nonzero(reached >= how.alpha - (after[k + 1][row, None] if k + 1 < how.parts else 0))
            row, name, so_far = row[at], name[at] * how.code + code, reached[at, code]
        rows.append(row)
        names.append(name)
    return np.concatenate(rows), np.concatenate(names)


def takes_part(vector: Column) -> Column:
    """Whether a vector is there, finite in all components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _passed(vectors: DataFrame, rows: int, cosine: float) -> DataFrame:
    """Adds `filters` to (vec_id, name_a, name_b, v): ids made of filter and length."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, Plan] = {}
        for batch in batches:
            column = batch.column("v")
            sizes, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy().astype(float)
            starts = np.cumsum(sizes) - sizes
            who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                how = plans.setdefault(size, plan(rows, max(size, LEAST_SIZE), cosine))
                for a in range(0, len(at), _DECODE_ROWS):
                    part = at[a : a + _DECODE_ROWS]
                    row, name = list_decode(unit(flat[starts[part][:, None] + np.arange(size)]), how)
                    who.append(part[row])
                    what.append(name << _SIZE_BITS | size)
            owner, value = np.concatenate(who), np.concatenate(what)
            order = np.lexsort((value, owner))
            ends = np.searchsorted(owner[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order]))], ["vec_id", "name_a", "name_b", "filters"])

    return vectors.mapInArrow(decode, "vec_id long, name_a long, name_b long, filters array<long>")


def forest(good: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members which chains of `good` pairs join."""
    out, left = [], np.ones(len(good), bool)
    for k in range(len(good)):
        front = [k] if left[k] else []
        left[k] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(good[at] & left)
            left[new] = False
            out.extend((at, int(j)) for j in new)
            front.extend(new.tolist())
    return out


def _earlier(filters: pa.Array, now: int) -> np.ndarray:
    """Whether each two members share a filter that comes before this one."""
    value, who = filters.flatten().to_numpy(), np.repeat(np.arange(len(filters)), pc.list_value_length(filters).to_numpy())
    before = value < now
    value, who = value[before], who[before]
    both = np.zeros((len(filters), len(filters)), bool)
    _, column, seen = np.unique(value, return_inverse=True, return_counts=True)
    many = seen > 1
    keep = many[column]
    who, column = who[keep], (np.cumsum(many) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    for a in range(0, int(many.sum()), 2048):
        lo, hi = np.searchsorted(column, (a, a + 2048))
        part = np.zeros((len(filters), 2048), np.float32)
        part[who[lo:hi], column[lo:hi] - a] = 1
        both |= part @ part.T > 0
    return both


def _compared(met: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): forest links with n null, and per member the number of vectors it is linked with here, with b null."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def solve(group: pa.RecordBatch) -> None:
            x = unit(group.column("v").flatten().to_numpy().reshape(group.num_rows, -1).astype(float))
            good = x @ x.T >= cosine
            np.fill_diagonal(good, False)
            if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
                own = group.column("own").to_numpy()
                good &= own[:, None] != own[None, :]
            if not good.any():
                return
            ids = group.column("rep").to_pylist()
            for i, j in forest(good):
                for column, value in zip(out, (ids[i], ids[j], None), strict=True):
                    column.append(value)
            new = good & ~_earlier(group.column("filters"), group.column("filter")[0].as_py())
            counts = new @ group.column("weight").to_numpy()
            for i in np.flatnonzero(counts).tolist():
                for column, value in zip(out, (ids[i], None, int(counts[i])), strict=True):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])
            for column in out:
                column.clear()
            return made

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("filter", "lo", "hi")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    solve(batch.slice(a, b - a))
            rest = batch.slice(edges[-1])
            yield flush()
        if rest is not None and rest.num_rows > 1:
            solve(rest)
        yield flush()

    return met.mapInArrow(rows, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    named = vectors.select("vec_id", v.alias("v"), (takes_part(v) & F.col("vec_id").isNotNull()).alias("part")).withColumns(
        {"name_a": F.xxhash64("v"), "name_b": F.xxhash64(F.lit(1), "v")}
    )
    there = named.filter("part").select("vec_id", "name_a", "name_b")
    members = there.distinct()
    classes = stage(members.groupBy("name_a", "name_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    n = classes.count()
    firsts = named.filter("part").join(classes.select("name_a", "name_b", F.col("rep").alias("vec_id")).hint("merge"), ["name_a", "name_b", "vec_id"], "left_semi")
    passed = stage(_passed(firsts.select("vec_id", "name_a", "name_b", "v"), n, cosine))
    # A filter counts if two classes pass it; equal rows, which pass it twice, are one class.
    entries = passed.select("name_a", "name_b", F.explode("filters").alias("filter"))
    name = F.struct("name_a", "name_b")
    crowds = entries.groupBy("filter").agg(F.min(name).alias("one"), F.max(name).alias("other"), F.count("*").alias("n")).filter("one < other")
    shared = stage(
        entries.distinct().join(crowds.select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "filter")
        .groupBy("name_a", "name_b").agg(F.collect_list(F.struct("filter", "blocks")).alias("crowds"))  # as many as a vector passes
    )
    # The vectors of the classes that share a filter, once each.
    full = (
        firsts.select("name_a", "name_b", "v").join(shared.hint("merge"), ["name_a", "name_b"])
        .groupBy("name_a", "name_b").agg(F.first("v").alias("v"), F.first("crowds").alias("crowds"))
        .join(classes, ["name_a", "name_b"])
    )
    own = F.pmod(F.xxhash64("name_a", "name_b"), F.col("crowd.blocks")).cast("int")
    met = (
        full.select("rep", "weight", "v", F.array_sort(F.col("crowds.filter")).alias("filters"), "name_a", "name_b", F.explode("crowds").alias("crowd"))
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("crowd.blocks") - 1)))
        .select(F.col("crowd.filter").alias("filter"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "weight", "v", "filters")
    )
    found = stage(_compared(met.repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi", "rep"), cosine))
    # Classes that share an id are one component.
    same = classes.join(members, ["name_a", "name_b"]).filter("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    shared_ids = members.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("vec_id").alias("b"))
    labels = components(found.filter("b IS NOT NULL").select("a", "b").union(same.join(shared_ids, "b", "left_semi").select("a", "b")))
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    facts = (
        classes.join(counts, classes["rep"] == counts["a"], "left").drop("a")
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("name_a", "name_b", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    rows = named.select("vec_id", F.when(F.col("part"), F.col("name_a")).alias("name_a"), F.when(F.col("part"), F.col("name_b")).alias("name_b"))
    return (
        rows.join(facts, ["name_a", "name_b"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), both_ways AS (
  SELECT DISTINCT p.vec_id AS a, q.vec_id AS b FROM v p, v q WHERE p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.9
), reach AS (
  SELECT a AS node, b AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = other
), least AS (
  SELECT node, min(other) AS m FROM reach GROUP BY node
), links AS (
  SELECT a, count(*) AS n FROM both_ways GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id IS NULL OR vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN links ON a = vec_id LEFT JOIN least ON node = vec_id
"""
