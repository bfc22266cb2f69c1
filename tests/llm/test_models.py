"""Toxicity and language-model scores against plain Python and held-out data."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import suffix_tree, toxicity
from pixelmill.llm.queries import QUERIES
from pixelmill.llm.textarrays import texts_of

import pyarrow as pa

from conftest import SF
from llm_cases import EDGE, corpus, docs_of  # noqa: F401

LARGER = SF.replace("sf0.001", "sf0.1")


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, LARGER).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic) > 50
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_offending_sentences_are_found(docs_of, spark):
    clean = ["the sun is up today", "we went to the long lake", "a table and a chair stand here"]
    rows = [(k, ". ".join([clean[k % 3], "vile rubbish you are" if k % 4 == 0 else clean[(k + 1) % 3], clean[(k + 2) % 3]]) + ".") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(1, None)], "doc_id long, toxic int")
    docs = docs_of(rows)
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        text = dict(rows)[r.doc_id]
        assert (r.score >= 0.3) == (r.doc_id % 4 == 0)
        assert [text[s.start : s.end] for s in r.offending] == ["vile rubbish you are"] * (r.doc_id % 4 == 0)
    left = toxicity.drop_toxic(docs, model)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [k for k in range(400) if k % 4]


def test_labels_of_the_held_out_quarter_teach_nothing(docs_of, spark):
    rows = [(k, "vile words here" if k % 2 else "kind words here") for k in range(200)]
    out = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    model = toxicity.fit(docs_of(rows), spark.createDataFrame([(k, k % 2) for k in out], "doc_id long, toxic int"))
    assert len(model.keys) == 0


def test_noisy_or_and_gradient():
    p, owner = np.array([0.5, 0.2, 0.9]), np.array([0, 0, 2])
    assert toxicity.noisy_or(p, owner, 3, 0.1).tolist() == pytest.approx([0.6, 0.1, 0.9])


def test_toxicity_edge_cases(docs_of, spark):
    docs = docs_of(EDGE)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.offending == [] for r in rows)
    assert toxicity.drop_toxic(docs, model).schema == docs.schema
    assert toxicity.score(docs_of([]), model).count() == 0


def tree_of(docs):
    return suffix_tree.fit(docs.withColumn("held_out", suffix_tree.held_out(F.col("doc_id"))))


def test_base_scores_equal_plain_python(spark, corpus):
    tokens = {i: [*t.encode().lower().split(), None] for i, t in corpus.items()}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in tokens.items() if i not in out for w in t)
    n = sum(counts.values())
    total = math.log10(n + 0.1 * (len(counts) + 1))
    rows = QUERIES["op6_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        mine = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in out, len(mine), sum(counts[w] > 0 for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - total for w in mine), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_equal_a_plain_walk_of_the_tree(docs_of, spark):
    texts = [(k, " ".join(["red", "green", "blue" if k % 2 else "black", "x%d" % (k % 7), "end"] * 6)) for k in range(60)]
    docs = docs_of(texts)
    tree = tree_of(docs)
    assert tree.levels[0].kept.any()

    def number(word):
        name = suffix_tree.END if word is None else suffix_tree.texts_of(pa.array([word])).word_hashes[0] | np.uint64(2)
        at = np.flatnonzero(tree.words == name)
        return int(at[0]) if len(at) else -1

    lists = [{}, {}, {}]
    kept = [{}, {}, {}]
    names = [{}, {}, {}]
    for d, level in enumerate(tree.levels):
        for k, key in enumerate(level.keys.tolist()):
            words = (key,) if d == 0 else (*names[d - 1][key >> 32], key & 0xFFFFFFFF)
            names[d][k] = words
            if level.kept[k]:
                kept[d][words] = level.log_rest[k]
        for key, p in zip(level.entries.tolist(), level.log_p.tolist()):
            lists[d][(*names[d][key >> 32], key & 0xFFFFFFFF)] = p

    def log_p(history, word):
        for d in (2, 1, 0):
            context = tuple(history[-d - 1 :])
            if len(context) == d + 1 and context in kept[d]:
                if (*context, word) in lists[d]:
                    return lists[d][(*context, word)]
                shorter = log_p_below(history, word, d)
                return kept[d][context] + shorter
        return float(tree.log_root[word]) if word >= 0 else math.log10(0.1) - tree.log_total

    def log_p_below(history, word, depth):
        return log_p(history[-depth:] if depth else [], word)

    rows = suffix_tree.score(docs.withColumn("held_out", F.lit(False)), tree).collect()
    for r in rows:
        ids = [number(w) for w in dict(texts)[r.doc_id].split()] + [number(None)]
        assert min(ids) >= 0
        assert r.score == pytest.approx(sum(log_p(ids[:k], w) for k, w in enumerate(ids)), rel=1e-9)


def words_of(tree, depth, k):
    """The numbers of a context's words."""
    key = int(tree.levels[depth].keys[k])
    return [key] if depth == 0 else [*words_of(tree, depth - 1, key >> 32), key & 0xFFFFFFFF]


def test_next_word_probabilities_sum_to_one(docs_of):
    """In every kept state, with the states of its own suffixes behind it; rarer words have what is left."""
    tree = tree_of(docs_of([(k, f"a b c{k % 5} a b d{k % 3} e{k % 2} b") for k in range(100)]))
    n, seen = len(tree.words), 0
    for depth, level in enumerate(tree.levels):
        for k in np.flatnonzero(level.kept):
            history = np.array([*words_of(tree, depth, k), 0])
            states = [c[-1:] for c in tree.contexts(history, np.arange(len(history)) == 0)]
            assert states[depth] == k
            known = 10 ** tree.log_p(np.arange(n), [np.repeat(c, n) for c in states], tree.log_root)
            assert 0.5 < known.sum() <= 1 + 1e-9
            seen += 1
    assert seen > 5


def plain_tree(texts, levels=3):
    """Context -> (list of next words with probabilities, what is left for shorter ones), by dictionaries."""
    rows = [[*t.split(), None] for t in texts]
    counts = Counter(w for r in rows for w in r)
    n, v = sum(counts.values()), len(counts)
    least, gamma = suffix_tree.least_seen(n), suffix_tree.GAMMA
    listable = {w for w, c in counts.items() if c >= max(2, gamma * least) or w is None}
    kept = {}

    def p(context, word):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (counts[word] + 0.1) / (n + 0.1 * (v + 1))
        listed, left = kept[context]
        return listed[word] if word in listed else left * p(context[1:], word)

    contexts = {(w,): counts[w] for w in listable if w is not None and counts[w] >= least}
    for depth in range(levels):
        pairs = Counter((tuple(r[i - depth - 1 : i]), r[i]) for r in rows for i in range(depth + 1, len(r)) if r[i] in listable and tuple(r[i - depth - 1 : i]) in contexts)
        pairs = {k: c for k, c in pairs.items() if c >= max(2, gamma * least)}
        found = {}
        for context, count in contexts.items():
            next_ = {w: c for (x, w), c in pairs.items() if x == context and c / count >= gamma}
            base = {w: p(context[1:], w) for w in next_}
            rest, base_rest = max(1 - sum(next_.values()) / count, 1e-9), max(1 - sum(base.values()), 1e-9)
            gain = sum(c / count * math.log(c / count / base[w]) for w, c in next_.items()) + rest * math.log(rest / base_rest)
            if next_ and count * gain > 0.5 * len(next_) * math.log(max(count, 2)):
                listed = {w: max(c - 0.5, 1e-3) / count for w, c in next_.items()}
                found[context] = listed, max(1 - sum(listed.values()), 1e-9) / base_rest
        kept.update(found)
        contexts = {(*x, w): c for (x, w), c in pairs.items() if c >= least and w is not None}
    return kept


def test_the_fit_equals_plain_dictionaries(docs_of):
    rng = random.Random(12)
    texts = []
    for k in range(150):
        t = ["start"]
        for _ in range(rng.randrange(1, 30)):
            t.append(rng.choice({"start": ["a", "b"], "a": ["b", "c", "a"], "b": ["c", "d", f"r{k % 9}"]}.get(t[-1], ["a", "b", "c", "d", "start"])))
            if t[-2:] == ["b", "c"] and rng.random() < 0.8:
                t.append("z")
        texts.append(" ".join(t))
    tree, want = tree_of(docs_of(list(enumerate(texts)))), plain_tree([t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10])
    vocabulary = {w for t in texts for w in t.split()}
    number = {int(np.flatnonzero(tree.words == (suffix_tree.texts_of(pa.array([w])).word_hashes[0] | np.uint64(2)))[0]): w for w in vocabulary if (suffix_tree.texts_of(pa.array([w])).word_hashes[0] | np.uint64(2)) in tree.words}
    number[int(np.flatnonzero(tree.words == suffix_tree.END)[0])] = None
    got = {}
    for depth, level in enumerate(tree.levels):
        for k in np.flatnonzero(level.kept).tolist():
            own = np.flatnonzero(level.entries >> np.uint64(32) == k)
            listed = {number[int(level.entries[i]) & 0xFFFFFFFF]: 10 ** level.log_p[i] for i in own}
            got[tuple(number[w] for w in words_of(tree, depth, k))] = listed, 10 ** level.log_rest[k]
    assert got.keys() == want.keys() and len({len(c) for c in got}) > 1
    for context, (listed, left) in want.items():
        assert got[context][0] == pytest.approx(listed) and got[context][1] == pytest.approx(left)


def test_the_tree_grows_with_the_corpus(docs_of):
    rng = random.Random(2)
    texts = [(k, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(150))) for k in range(400)]
    small, large = (tree_of(docs_of(texts[:n])) for n in (50, 400))
    assert all(len(b.keys) > len(a.keys) for a, b in zip(small.levels[:2], large.levels[:2])) and len(large.words) > len(small.words)


def test_model_edge_cases(docs_of):
    docs = docs_of(EDGE)
    rows = suffix_tree.score(docs.withColumn("held_out", F.lit(True)), tree_of(docs)).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len((t or "").encode().split()) + 1 for _, t in EDGE)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    empty = docs_of([])
    assert suffix_tree.score(empty.withColumn("held_out", F.lit(True)), tree_of(empty)).count() == 0
    rows = suffix_tree.score(docs.withColumn("held_out", F.lit(True)), tree_of(empty)).collect()
    assert len(rows) == len(EDGE) and all(r.n_known == 0 and r.base_score == 0 for r in rows)
