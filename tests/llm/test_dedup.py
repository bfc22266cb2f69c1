"""Near duplicates, repeated strings and repeated passages against plain Python."""

import hashlib
import os
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pixelmill.llm import minhash, partners, passages, repeats
from pixelmill.llm.graph import components
from pixelmill.llm.queries import QUERIES
from pixelmill.llm.suffixes import common_prefixes, suffix_array
from pixelmill.llm.textarrays import changes, slices

from conftest import SF
from llm_cases import EDGE, corpus, docs_of  # noqa: F401


def words(text):
    return (text or "").encode().lower().split()


def near(rows, percent=75):
    """doc_id -> (set size, component), over distinct ids."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_shingle[g].append(i)
    both = Counter((a, b) for ids in by_shingle.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def kept_bytes(rows, size=100):
    """doc_id -> (bytes, removed, spans, kept), over distinct ids in order."""
    seen, out = set(), {}
    for i, text in sorted(dict(rows).items()):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - size + 1):
            if raw[p : p + size] in seen:
                gone[p : p + size] = [True] * size
            seen.add(raw[p : p + size])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def test_near_duplicates_equal_brute_force(spark, corpus):
    want = near(corpus.items())
    rows = QUERIES["op9_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_a_large_group_of_near_copies(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, base[0] + " " + " ".join(f"x{i}y{k}" for k in range(50))) for i in range(20)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert found == near(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 100, 150))
    sig = minhash.signatures(np.array([0, 800]), np.concatenate([both, one, both, two]), 512)
    assert (sig[0] == sig[1]).mean() == pytest.approx(700 / 950, abs=0.08)
    assert len(set(sig[0].tolist())) > 400


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 102), (101, 102), (7, 7), (200, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_edge_cases(docs_of):
    docs = docs_of(EDGE)
    rows = minhash.near_duplicates(docs).collect()
    want = near([(i, t) for i, t in EDGE if i is not None])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == sorted((i, *want[i]) for i, _ in EDGE if i is not None)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10]
    assert minhash.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_equals_sorting(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        depth, low = int(rng.integers(2, 9)), int(rng.choice([0, 97]))
        texts = [rng.integers(low, low + rng.integers(1, 5), depth - 1 + rng.integers(1, 12)).astype(np.uint8) for _ in range(rng.integers(1, 8))]
        ends = np.cumsum([len(t) for t in texts])
        starts, data = ends - [len(t) for t in texts], np.concatenate(texts)
        order = suffix_array(data, starts, ends, ends - starts - depth + 1, depth)
        keys = [bytes(data[p : p + depth]) for p in order]
        assert keys == sorted(keys)
        assert sorted(order.tolist()) == [p for a, b in zip(starts, ends) for p in range(a, b - depth + 1)]
        common = common_prefixes(data, order, depth)
        for k in range(1, len(keys)):
            assert common[k] == next((j for j in range(depth) if keys[k][j] != keys[k - 1][j]), depth)


@pytest.mark.parametrize("spread,chunk", [(4096, 2 << 20), (1, 3000)])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, spread, chunk):
    monkeypatch.setattr(repeats, "SPREAD", spread)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    want = kept_bytes(corpus.items())
    rows = QUERIES["op1_suffix_array_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


def test_repeat_edge_cases(docs_of):
    shared = "ünï çödé passage that stands in several texts, " * 3
    cases = [*EDGE, (20, shared + "and goes on"), (21, "x" + shared), (22, "é" * 80 + shared[1:]), (23, "ab" * 300), (24, shared[:99])]
    docs = docs_of(cases)
    want = kept_bytes([(i, t) for i, t in cases if i is not None])
    rows = repeats.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept)) for r in rows if r.doc_id is not None) == sorted((i, want[i][0], want[i][2], want[i][3]) for i, _ in cases if i is not None)
    assert all(not r.removed for r in rows if r.doc_id is None)
    left = repeats.drop_repeats(docs)
    assert left.schema == docs.schema
    by_id = {r.doc_id: r for r in left.collect()}
    assert 7 not in by_id and by_id[1].text is None and by_id[6].text == dict(cases)[6]
    for r in by_id.values():
        assert r.n_chars == len(r.text or "") and (r.doc_id is None or len((r.text or "").encode()) >= len(want[r.doc_id][3]))
    assert repeats.remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("spread", [4096, 1])
def test_repeated_rows_are_one_document(docs_of, monkeypatch, spread):
    monkeypatch.setattr(repeats, "SPREAD", spread)
    text = lambda a, b: " ".join(f"w{k * k}" for k in range(a, b))
    cases = [(30, text(100, 200))] * 5 + [(31, text(150, 300))] * 2 + [(32, text(500, 560) + " " + text(500, 560))] * 3 + [(33, text(100, 200))]
    want = kept_bytes(cases)
    docs = docs_of(cases)
    rows = repeats.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept)) for r in rows) == sorted((i, want[i][0], want[i][2], want[i][3]) for i, _ in cases)
    left = repeats.drop_repeats(docs).collect()
    assert [r.text for r in left if r.doc_id == 30] == [text(100, 200)] * 5
    assert Counter(r.doc_id for r in left) == {30: 5, 31: 2, 32: 3}


@pytest.mark.parametrize("piece", [1, 37, 5000])
def test_repeats_do_not_depend_on_pieces(docs_of, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    text = lambda a, b: " ".join(f"w{k * k}" for k in range(a, b))
    cases = [(1, text(100, 200)), (2, "new " + text(120, 300) + " " + text(150, 190)), (3, text(0, 110)), (4, "ab" * 300), (5, "xab" * 5 + "ab" * 200)]
    want = kept_bytes(cases)
    rows = repeats.remove_repeats(docs_of(cases)).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept)) for r in rows) == sorted((i, want[i][0], want[i][2], want[i][3]) for i, _ in cases)


def test_a_repeat_worker_holds_little_beside_its_batch():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(10**6, size=40_000)) for _ in range(12)]
    batch = pa.record_batch({"doc_id": pa.array(range(12), pa.int64()), "text": pa.array(texts)})
    next(repeats._places(100)(iter([batch.slice(0, 1)])))  # tables that stay
    tracemalloc.start()
    found = sum(b.num_rows for b in repeats._places(100)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 50_000 and peak < 64e6


def test_texts_travel_in_small_batches(spark, docs_of):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    try:
        spark.conf.unset(key)
        docs = docs_of([(k, f"{k} " * 20_000) for k in range(300)])
        repeats.drop_repeats(docs)
        most = docs.coalesce(1).mapInArrow(sizes, "n long").agg({"n": "max"}).collect()[0][0]
        assert most < 8e6
        spark.conf.set(key, "123456")
        repeats.drop_repeats(docs)
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_passages_cover_every_long_repeat(spark, corpus):
    texts = {i: words(t) for i, t in corpus.items()}
    spans = defaultdict(list)
    for r in QUERIES["op5_substring_dedup"](spark, SF).collect():
        own, ref = (texts[i][a : a + n] for i, a, n in ((r.doc_id, r.start_word, r.n_words), (r.ref_doc_id, r.ref_start_word, r.ref_n_words)))
        assert (len(own), len(ref)) == (r.n_words, r.ref_n_words) and r.ref_doc_id < r.doc_id
        assert r.copy == (own == ref and len(own) == len(texts[r.doc_id]) == len(texts[r.ref_doc_id])) or own == ref
        spans[r.doc_id].append((r.start_word, r.start_word + r.n_words))
    seen, repeats_seen = {}, 0
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            run = tuple(texts[i][p : p + 50])
            if seen.setdefault(run, i) != i:
                repeats_seen += 1
                assert max(min(b, p + 50) - max(a, p) for a, b in spans[i]) >= 45
    assert repeats_seen


def test_fuzzy_passage_and_clean_texts(docs_of):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(80)]
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    del fuzzy[45]
    fuzzy.insert(60, "added")
    rows = [(1, " ".join([word() for _ in range(50)] + passage + [word() for _ in range(40)])), (2, " ".join([word() for _ in range(15)] + fuzzy + [word() for _ in range(70)])), (3, " ".join(word() for _ in range(200)))]
    found = passages.repeated_passages(docs_of(rows)).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.ref_doc_id, r.ref_start_word, r.ref_n_words, r.n_matched, r.copy) for r in found] == [(2, 15, 80, 1, 50, 80, 78, False)]


def test_passage_of_lines_that_each_stand_elsewhere_before(docs_of):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    lines = [[word() for _ in range(13)] for _ in range(40)]
    fill = lambda n: [word() for _ in range(n)]
    rows = [(k, fill(20) + line + fill(20)) for k, line in enumerate(lines)]
    # Borders of two lines stand elsewhere before, too: only longer runs tell.
    rows += [(50 + k, fill(20) + a[-8:] + b[:8] + fill(20)) for k, (a, b) in enumerate(zip(lines, lines[1:]))]
    for k in range(10):
        passage = sum(lines[4 * k : 4 * k + 4], [])
        rows += [(100 + k, fill(30) + passage + fill(30)), (200 + k, fill(10) + passage + fill(50))]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).collect()
    assert sorted((r.doc_id, r.ref_doc_id, r.start_word, r.n_words) for r in found if r.doc_id >= 200) == [(200 + k, 100 + k, 10, 52) for k in range(10)]


@pytest.mark.parametrize("every", [6, 8, 12])
def test_passages_with_many_edits(docs_of, every):
    rng = random.Random(every)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(60):
        passage = fill(50)
        edited = [f"changed{k}x{j}" if j % every == every - 1 else w for j, w in enumerate(passage)]
        rows += [(k, fill(30) + passage + fill(30)), (100 + k, fill(30) + edited + fill(30))]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {(100 + k, k) for k in range(60)}


def test_chains_follow_the_best_order():
    runs = np.array([[0, 100, 10], [12, 50, 5], [14, 112, 10], [30, 200, 5], [40, 130, 10]])
    assert passages.chains(runs)[0] == [0, 2, 4]
    assert sorted(sum(passages.chains(runs), [])) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("step", [1, -1])
def test_reaches_equal_a_plain_walk(step):
    rng = np.random.default_rng(5)
    own, other = (rng.integers(0, 2, 6000).astype(np.uint32) for _ in range(2))
    other[:3000] = np.where(rng.random(3000) < 0.8, own[:3000], 7)
    x = rng.integers(100, 5900, 5000)
    y = np.where(rng.random(5000) < 0.7, x, rng.integers(100, 5900, 5000))
    room = rng.integers(0, passages.MARGIN + 1, 5000)

    def walk(p, q, n):
        best, gain, top, at, matched = 0, 0, None, (0, 0), 0
        if not any(own[p + step * k] == other[q + step * k] for k in range(min(n, 6))):
            return at
        for k in range(n):
            hit = own[p + step * k] == other[q + step * k]
            gain, matched = gain + (1 if hit else -2), matched + int(hit)
            top = gain if top is None else max(top, gain)
            if top - gain > 8:
                break
            if gain > best:
                best, at = gain, (k + 1, matched)
        return at

    found = passages.reaches(own, other, x, y, room, step)
    assert list(zip(*(f.tolist() for f in found))) == [walk(*r) for r in zip(x.tolist(), y.tolist(), room.tolist())]
    none = np.zeros(0, np.int64)
    assert [len(f) for f in passages.reaches(own, other, none, none, none, step)] == [0, 0]


def test_order_by_leading_bits_is_exact_and_stable():
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.integers(0, 2**64 - 1, 500, np.uint64, True), rng.integers(0, 40, 500, np.uint64), np.uint64(2**64 - 1) - rng.integers(0, 40, 500, np.uint64)])
    for some in (values, values[:1], values[:0], np.repeat(values, 2)):
        assert passages.by_value(some).tolist() == np.argsort(some, kind="stable").tolist()


def test_rounds_leave_no_shuffles_and_no_tables_behind(docs_of, spark, monkeypatch):
    """One part of the seeds is on its way at a time, and each round's shuffles and used tables are gone before the next."""
    held, most, staged, packed = [], [], passages.stage, passages._packing
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.split("_")[1] for b in store.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffles()

    def watched(df, **how):
        table = staged(df, **how)
        held.append(table.staged_at)
        for _ in range(50):  # they go soon, not at once
            if len(shuffles() - before) > 1:
                time.sleep(0.1)
        most.append(len(shuffles() - before))
        return table

    parts = []
    monkeypatch.setattr(passages, "stage", watched)
    monkeypatch.setattr(passages, "_packing", lambda n, bits, only: parts.append((n, only)) or packed(n, bits, only))
    text = " ".join(f"w{k}" for k in range(80))
    found = passages.repeated_passages(docs_of([(1, text + " a"), (2, text + " b")]))
    assert [(r.doc_id, r.ref_doc_id, r.n_words) for r in found.collect()] == [(2, 1, 80)]
    n = parts[0][0]
    assert len(parts) == passages.ROUNDS > 1 and [b for _, some in parts for b in some] == list(range(n))
    assert max(most) <= 1  # that of the documents themselves, which the test deals out
    left = [p for p in held if os.path.exists(p.removeprefix("file://"))]
    assert left == [held[0], *held[-passages.ROUNDS :]]  # the texts' names and the results


def test_passage_edge_cases(docs_of):
    found = passages.repeated_passages(docs_of(EDGE)).collect()
    assert sorted((r.doc_id, r.ref_doc_id, r.copy) for r in found) == [(5, 4, True), (5, 4, True), (7, 6, True)]
    assert passages.repeated_passages(docs_of([])).count() == 0


def test_a_word_said_over_and_over(docs_of):
    """A few passages, not one per word, and together they cover the run."""
    rows = [(1, "start here " + "of " * 90 + "and on"), (2, " ".join(f"u{k}" for k in range(40)) + " of" * 400 + " end")]
    found = passages.repeated_passages(docs_of(rows)).collect()
    assert 1 <= len(found) <= 400 // passages.SPACING + 2
    covered = set().union(*(range(r.start_word, r.start_word + r.n_words) for r in found))
    assert set(range(40, 440)) - covered <= set(range(400, 440))


@pytest.mark.parametrize("kept,packed", [(4, 1 << 21), (1, 300), (10**6, 300)])
def test_first_places_equal_brute_force(docs_of, monkeypatch, kept, packed):
    """Every place of every seed, also of one that a task has often."""
    monkeypatch.setattr(passages, "KEPT", kept)
    monkeypatch.setattr(passages, "PACKED", packed)
    rng = random.Random(8)
    phrase = [f"p{k}" for k in range(12)]
    rows = [(i, [w for _ in range(6) for w in (phrase if rng.random() < 0.5 else [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))])]) for i in range(60)]
    rows += [(100, [f"u{k}" for k in range(200)]), (101, [f"u{k}" for k in range(200)]), (102, ["x"] * 100)]
    first, places = {}, []
    for i, words_ in sorted(rows):
        for size, mark in ((5, 0), (30, 1)):
            for p in range(len(words_) - size + 1):
                key = tuple(words_[p : p + size])
                places.append((i, 2 * p + mark, key))
                first.setdefault(key, (i, 2 * p + mark))
    every = {(i, p, *first[key]) for i, p, key in places if first[key][0] < i}
    found = [tuple(r) for r in passages.first_places(docs_of([(i, " ".join(t)) for i, t in rows]), 3).collect()]
    text = dict(rows)
    run = lambda i, p: text[i][p // 2 : p // 2 + (30 if p & 1 else 5)]
    assert len(found) == len(set(found)) and all(run(i, p) == run(j, q) and j < i for i, p, j, q in found)
    assert {r for r in found if not r[1] & 1} == {r for r in every if not r[1] & 1}
    long = sorted(r[1] // 2 for r in found if r[0] == 101 and r[1] & 1)
    assert long[0] < 5 and max(b - a for a, b in zip(long, long[1:])) <= 5 and long[-1] > 165


def test_runs_of_5_and_of_30_words_never_meet_by_chance(docs_of, monkeypatch):
    """Hashes so short that strangers meet all the time: a run of 30 words never matches the last words of a text."""
    homes = passages._seed_homes
    monkeypatch.setattr(passages, "_seed_homes", lambda docs, n_buckets, bits: homes(docs, n_buckets, 16))
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(50)]
    rows = [(i, [f"w{rng.randrange(10**9)}" for _ in range(12 if i < 80 else 90)]) for i in range(160)]
    rows += [(200, passage + ["a"] * 3), (201, ["b", "c"] + passage)]
    docs = docs_of([(i, " ".join(t)) for i, t in rows])
    matches = passages.first_places(docs, 3, 16).collect()
    size = {i: len(t) for i, t in rows}
    assert {r.place & 1 for r in matches} == {0, 1} and all(r.place & 1 == r.other & 1 for r in matches)
    assert all(p // 2 + (30 if p & 1 else 5) <= size[i] for r in matches for i, p in ((r.doc_id, r.place), (r.ref, r.other)))
    assert [(r.doc_id, r.ref_doc_id, r.n_words) for r in passages.repeated_passages(docs).collect()] == [(201, 200, 50)]


def test_order_of_numbers_that_lie_close_is_exact_and_stable():
    rng = np.random.default_rng(7)
    for low, spread in ((0, 5), (2**63, 2**20), (2**64 - 2**41, 2**41), (5, 2**60)):
        values = np.uint64(low) + rng.integers(0, spread, 3000, np.uint64)
        assert passages.by_value(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_a_text_that_equals_the_one_before_counts_nothing():
    texts = ["a" * 6, "a" * 6, "a" * 6, "b" * 6, None, None, "", "b" * 6, "b" * 6, "c" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    assert changes(batch.column(1)).tolist() == [True, False, False, True, True, True, True, True, False, True]
    parts = list(slices(iter([batch]), "text", 12, once=True))
    assert [p.num_rows for p in parts] == [7, 3] and sum((p.column(0).to_pylist() for p in parts), []) == list(range(10))
    assert [p.num_rows for p in slices(iter([batch]), "text", 12)] == [2, 5, 2, 1]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_a_passage_of_many_documents_refers_to_its_first(docs_of, monkeypatch, limit):
    """The first document stands beside the chains of every salt, and other documents between them."""
    monkeypatch.setattr(passages, "slices", lambda batches, column, **how: slices(batches, column, limit, **how))
    rng = random.Random(12)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fill(40), fill(60)]
    rows = [(0, fill(9) + shared[0])] + 2 * [(1, shared[1] + fill(9))]
    rows += [(2 + k, fill(k % 7) + shared[k % 2] + fill(k % 5)) for k in range(150)]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).select("doc_id", "ref_doc_id", "start_word", "n_words", "ref_start_word", "n_matched", "copy").distinct().collect()
    # Sampled runs at a text's edge may stand first in a later document, which is then referred to as well.
    want = {(2 + k, k % 2, k % 7, n, 0 if k % 2 else 9, n, False) for k in range(150) for n in ((40, 60)[k % 2],)}
    copied = {r.doc_id for r in found if r.copy}
    assert len(copied) < 10 and {tuple(r) for r in found if not r.copy and r.ref_doc_id < 2} == {w for w in want if w[0] not in copied}


def test_an_exact_repeat_of_34_words_is_found_wherever_its_parts_stand_first(docs_of):
    rng = random.Random(3)
    passage = [f"w{k}" for k in range(34)]
    rows = [(k, passage[5 * k : 5 * k + 9] + [f"a{k}b{j}" for j in range(40)]) for k in range(7)]
    rows += [(20, [f"c{j}" for j in range(50)] + passage + [f"d{j}" for j in range(30)]), (21, [f"e{j}" for j in range(rng.randrange(30))] + passage)]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).collect()
    assert [(r.doc_id, r.ref_doc_id, r.n_words) for r in found if r.doc_id == 21 and r.ref_doc_id == 20] == [(21, 20, 34)]


@pytest.mark.parametrize("limits", [{}, {"SALTED": 4, "_LARGE": 0, "_BLOCK": 16, "_RUNS": 200, "KEPT_PAIRS": 1}])
def test_an_edited_passage_is_found_wherever_its_pieces_stand_first(docs_of, monkeypatch, limits):
    """Each piece stands alone in an earlier document, so the passage's first holder is the first for none of its seeds."""
    for name, value in limits.items():
        monkeypatch.setattr(partners, name, value)
    rng = random.Random(13)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    edits = {"changed": lambda k: [f"x{k}"], "left out": lambda k: [], "added": lambda k: [f"y{k}", f"z{k}"]}
    rows, want = [], set()
    for n, edit in enumerate(edits.values()):
        pieces, ends = [fill(7) for _ in range(6)], fill(6)
        rows += [(10 * n + k, fill(20) + piece + fill(20)) for k, piece in enumerate(pieces)]
        # Two documents have it, and four more have it edited: a match for each, not for each pair.
        rows += [(100 + 10 * n + m, fill(9) + sum(([*piece, end] for piece, end in zip(pieces, ends)), []) + fill(12)) for m in range(2)]
        rows += [(200 + 10 * n + m, fill(3 + m) + sum((piece + edit(f"{m}x{k}") for k, piece in enumerate(pieces)), []) + fill(12)) for m in range(4)]
        want |= {(200 + 10 * n + m, 100 + 10 * n) for m in range(4)}
    # Those with words left out equal one another.
    want = {(i, 210) if 210 < i < 220 else (i, ref) for i, ref in want}
    # A first document that has all pieces elsewhere before.
    pieces = [fill(9) for _ in range(4)]
    rows += [(300, sum((fill(30) + piece for piece in pieces), []) + fill(30) + sum(([*piece, "u"] for piece in pieces), []))]
    rows += [(301, fill(10) + sum(([*piece, "v"] for piece in pieces), []) + fill(10))]
    # Short lines that many documents have make no passage.
    line = fill(12)
    rows += [(400 + k, fill(20 + k) + line + fill(30)) for k in range(20)]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).collect()
    text = dict(rows)
    assert {(r.doc_id, r.ref_doc_id) for r in found if r.doc_id >= 200} == want | {(301, 300)}
    for r in found:
        assert r.n_words >= 30 and 100 * r.n_matched >= 75 * max(r.n_words, r.ref_n_words)
        own, ref = text[r.doc_id][r.start_word : r.start_word + r.n_words], text[r.ref_doc_id][r.ref_start_word : r.ref_start_word + r.ref_n_words]
        assert len(set(own) & set(ref)) <= r.n_matched <= len(own)
    assert {(r.n_words, r.ref_n_words, r.n_matched) for r in found if 200 <= r.doc_id < 210} == {(47, 47, 42)}


def test_a_first_place_too_near_to_its_text_s_end_is_not_the_only_one(docs_of):
    """A word said 20 times stands first where 40 of it never come."""
    rows = [(1, ["a1"] + ["of"] * 20 + ["b1"] * 3), (2, ["a2"] + ["of"] * 45 + ["b2"] * 3), (3, ["a3", "c3"] + ["of"] * 33 + ["b3"] * 3)]
    found = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in rows])).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in found} == {(3, 2)}
    covered = set().union(*(range(r.start_word, r.start_word + r.n_words) for r in found))
    assert covered == set(range(2, 35))


def test_bounds_of_surroundings_let_every_passage_through():
    rng = np.random.default_rng(14)
    own = rng.integers(2, 60000, (4000, partners.WIDTH)).astype(np.uint16)
    other = np.where(rng.random(own.shape) < rng.uniform(0.5, 1, (len(own), 1)), own, rng.integers(2, 60000, own.shape)).astype(np.uint16)
    a, b = rng.integers(0, 31, len(own)), rng.integers(partners.LEFT + 5, partners.WIDTH + 1, len(own))
    at = np.arange(partners.WIDTH)
    other[(at < a[:, None]) | (at >= b[:, None])] = 1
    other[:, partners.LEFT : partners.LEFT + 5] = own[:, partners.LEFT : partners.LEFT + 5]
    moved = rng.random(len(own)) < 0.5
    other[moved, partners.LEFT + 8 : -1] = other[moved, partners.LEFT + 9 :]  # a word less
    found = np.zeros(len(own), bool)
    for k in range(0, len(own), 200):
        found[[k + p for p in partners.fits(own[k : k + 200], other[k : k + 200])]] = True
    assert 300 < found.sum() < 3900
    assert partners.alike(own, other)[found].all()
    assert partners.straight((own == other)[found & ~moved]).all()

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for w in x.tolist():
            row = [0] + [max(row[j + 1], row[j] + int(v == w)) for j, v in enumerate(y.tolist())]
            for j in range(len(y)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    small, its = rng.integers(2, 6, (5, partners.WIDTH)).astype(np.uint16), rng.integers(2, 6, (5, partners.WIDTH)).astype(np.uint16)
    assert partners.common(small, its).tolist() == [plain(x, y) for x, y in zip(small, its)]


def test_the_sql_of_repeats_counts_repeated_rows_once():
    import duckdb

    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(90))
    rows = [(1, text), (1, text), (2, "x" + text), (3, "short"), (4, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({repeats.OP1_SQL})").fetchall())
    assert [r[2] for r in want if r[0] == 1] == [0, 0] and [r[2] > 100 for r in want if r[0] == 2] == [True]
    assert {i: n for i, _, n, _, _ in want} == {i: gone for i, (_, gone, _, _) in kept_bytes(rows).items()}
