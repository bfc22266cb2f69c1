"""Hard negatives and near-duplicate vectors against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from pixelmill.llm import caps, negatives
from pixelmill.llm.queries import ORACLE, QUERIES

from compare import connect, difference
from conftest import SF

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("rep", T.StringType()), T.StructField("filter", T.StringType()), T.StructField("score", T.StringType())])
NAN, INF = float("nan"), float("inf")
#: Nulls, zero, bad components, other lengths, ties, repeated rows, large and tiny components.
ODD = [(None, [1.0, 2.0], 1), (None, None, None), (900, None, 1), (901, [], 1), (902, [0.0, 0.0], 1), (903, [1.0, None], 1), (904, [NAN, 1.0], 1), (905, [1.0, INF], 1),
       (906, [1.0, 2.0], None), (907, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [1.0, 2.0], 2), (909, [2.0, 4.0], 2), (910, [3.0], 1), (911, [1.0, 2.0, 3.0, 4.0], 1), (912, [1e-300, 2e-300], 3), (913, [-1.0, -2.0], 2)]


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], VECTORS).repartition(3)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def linked(rows, cosine=0.9):
    """vec_id -> (links, component) by comparing every two rows."""
    seen = {(i, tuple(v)) for i, v, _ in rows if i is not None and good(v) and any(v)}
    unit = [(i, [x / max(map(abs, v)) for x in v]) for i, v in seen]
    links, ids = defaultdict(set), sorted({i for i, _, _ in rows if i is not None})
    for i, u in unit:
        for j, w in unit:
            if i != j and len(u) == len(w) and sum(a * b for a, b in zip(u, w)) / math.hypot(*u) / math.hypot(*w) >= cosine:
                links[i].add(j)
    out = {}
    for i in ids:
        if i not in out:
            front, out[i] = [i], i
            while front:
                for j in links[front.pop()]:
                    if j not in out:
                        out[j] = i
                        front.append(j)
    return {i: (len(links[i]), out[i]) for i in ids}


def clusters(rng, n, size, copies, noise):
    centers = rng.standard_normal((n, size))
    return [(c + noise * rng.standard_normal(size)).tolist() for c in centers for _ in range(copies)]


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors_equal_brute_force(table, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = clusters(rng, 25, 16, 8, 0.2) + rng.standard_normal((100, 16)).tolist()
    vectors += vectors[:30] * 3
    rows = [(int(i), v, 1) for i, v in zip(rng.permutation(len(vectors)), vectors)] + ODD
    found = caps.near_vectors(table(rows)).collect()
    want = linked(rows)
    assert len(found) == len(rows)
    # The noise leaves no pair near the threshold's edge unseen: recall is 1 here.
    assert {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)] * 2


def test_no_vectors(table):
    assert caps.near_vectors(table([])).collect() == [] and negatives.hard_negatives(table([]), F.lit(True)).collect() == []


@pytest.mark.parametrize("rows,size", [(50_000, 64), (10**6, 64), (10_000, 8), (2_000, 200)])
def test_recall_of_pairs_at_the_threshold(rows, size):
    """Pairs of cosine 0.9 exactly, the hardest there are, under the code of a table of so many rows."""
    rng = np.random.default_rng(7)
    how = caps.plan(rows, size)
    x = caps.unit(rng.standard_normal((400, size)))
    y = rng.standard_normal((400, size))
    y = caps.unit(y - (x * y).sum(1, keepdims=True) * x)
    passed = [set(zip(*(a.tolist() for a in caps.list_decode(v, how)))) for v in (x, 0.9 * x + math.sqrt(0.19) * y)]
    assert len({i for i, _ in passed[0] & passed[1]}) >= 0.93 * 400
    assert len(passed[0]) < 400 * 4 * how.turns  # a few filters a vector


def test_list_decoding_finds_every_filter():
    how = caps.Plan(3, 3, 6, 0.3)
    x = caps.unit(np.random.default_rng(1).standard_normal((40, 9)))
    turn, codes = caps._codes(how, 9)
    want = set()
    for t, parts in enumerate(codes):
        for a in range(6):
            for b in range(6):
                for c in range(6):
                    direction = np.zeros(9)
                    for (own, code), k in zip(parts, (a, b, c)):
                        direction[own] = code[:, k]
                    want |= {(int(i), ((t * 6 + a) * 6 + b) * 6 + c) for i in np.flatnonzero(x @ turn @ direction >= 0.3)}
    assert set(zip(*(v.tolist() for v in caps.list_decode(x, how)))) == want


def mined(rows, is_anchor, positives=5, negatives_=10, low=30, high=90, scale=256):
    rows = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label in rows if i is not None and label is not None and good(v)}
    out = []
    for i, label, v in rows:
        if is_anchor(i):
            scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
            for ps, p, _ in sorted(s for s in scores if s[2] == label)[:positives]:
                fit = sorted(s for s in scores if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives_]
                out += [(i, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mine(df, anchor=lambda c: c % 10 == 0):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchor(F.col("vec_id"))).collect())


@pytest.mark.parametrize("kind", ["even", "clustered", "small", "sparse"])
def test_hard_negatives_equal_brute_force(table, kind, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(negatives, "BLOCK_LEAST", 40)
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 12 * 50)  # several blocks and chunks
    monkeypatch.setattr(negatives, "SCORES", 300)
    v = {"even": rng.standard_normal((300, 12)), "clustered": np.array(clusters(rng, 15, 12, 20, 0.1)), "small": rng.integers(-2, 3, (300, 12)) / 256,
         "sparse": rng.standard_normal((300, 12)) * (rng.random((300, 12)) < 0.2) * 10.0 ** -np.arange(12)}[kind]
    rows = [(i, x, int(k)) for i, (x, k) in enumerate(zip(v.tolist(), rng.choice(4, 300, p=[0.6, 0.2, 0.19, 0.01])))] + ODD
    assert mine(table(rows)) == mined(rows, lambda i: i % 10 == 0)


def test_few_rows_and_lonely_labels(table):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (10, [1.0, 1.0], 9)]
    assert mine(table(rows)) == mined(rows, lambda i: i % 10 == 0) and len(mine(table(rows))) == 2


def test_large_components_are_exact_or_an_error(table):
    rows = [(0, [1e6, 3e6], 1), (1, [2e6, 1e6], 1), (2, [1e6, 7e5], 2), (3, [9e5, 7e5], 2)]
    assert mine(table(rows)) == mined(rows, lambda i: i % 10 == 0) != []
    with pytest.raises(Exception, match="64 bits"):
        mine(table([(0, [1e300, 1e300], 1), (1, [1e300, 1e300], 1), (2, [1e299, 1e300], 2)]))


def test_threshold_join_finds_all_and_only_those():
    rng = np.random.default_rng(2)
    q, x = (np.floor(100 * rng.standard_normal((n, 20)) * 0.7 ** np.arange(20)) for n in (30, 400))
    for least in (np.full(30, -negatives._FLOOR * -1), np.zeros(30), np.quantile(q @ x.T, 0.95, axis=1), np.full(30, 1e9)):
        got = {(int(a), int(b), int(s)) for part in negatives.threshold_join(q, x, least) for a, b, s in zip(*part)}
        assert got == {(a, b, int(s)) for a, row in enumerate(q @ x.T) for b, s in enumerate(row) if s >= least[a]}


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_embedding_near_dedup"])
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_exact_search_with_large_components(table):
    from pixelmill.llm import nearest

    rows = [(50, [3e10, -2e10], 1), (51, [-1e10, 2e6], 1), (52, [2e10, 2e10], 1), (53, [50.0, 1e10], 1)]
    want = sorted(((sum(int(a) * int(b) for a, b in zip(rows[0][1], v)), i) for i, v, _ in rows[1:]), key=lambda r: (-r[0], r[1]))[:2]
    with pytest.raises(Exception, match="64 bits"):  # 6e20
        nearest.top_k(table(rows).select("vec_id", "embedding"), F.col("vec_id") == 50, k=3, scale=10).collect()
    small = [(i, [x / 10 for x in v], label) for i, v, label in rows]
    found = nearest.top_k(table(small).select("vec_id", "embedding"), F.col("vec_id") == 50, k=2, scale=1).orderBy("rank").collect()
    assert [(r.score, r.vec_id) for r in found] == [(s // 100, i) for s, i in want]
    with pytest.raises(Exception, match="64 bits"):
        nearest.top_k(table([(50, [1e300], 1), (51, [1.0], 1)]).select("vec_id", "embedding"), F.col("vec_id") == 50).collect()
