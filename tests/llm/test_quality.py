import re
from collections import Counter

import numpy as np
import pytest

from pixelmill.llm import quality
from pixelmill.llm.queries import QUERIES

from conftest import SF
from llm_cases import EDGE, corpus, docs_of  # noqa: F401


def plain(text):
    words = re.findall("[^ \t-\r]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(zip(*(words[k:] for k in range(5))))
    rep = [False] * len(words)
    for k in range(len(words) - 4):
        if runs[tuple(words[k : k + 5])] > 1:
            rep[k : k + 5] = [True] * 5
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), dup, sum(rep)


def test_metrics_equal_plain_python(spark, corpus):
    rows = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: plain(t) for i, t in corpus.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_verdict_follows_the_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL")
    rows = QUERIES["op10_quality_rules"](spark, SF).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_estimate_finds_known_accuracies():
    rng = np.random.default_rng(3)
    n, k = 40_000, len(quality.RULES)
    truth = rng.random(n) < 0.8
    right, found = np.full(k, 0.97), np.linspace(0.3, 0.8, k)
    good = np.where(truth[:, None], rng.random((n, k)) < right, rng.random((n, k)) >= found)
    patterns, counts = np.unique((np.where(good, 1, 2) * 3 ** np.arange(k)[::-1]).sum(1), return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert model.prior_good == pytest.approx(0.8, abs=0.02)
    assert np.allclose(model.good_right, right, atol=0.02) and np.allclose(model.bad_right, found, atol=0.05)


def test_edge_cases(docs_of):
    docs = docs_of(EDGE)
    model = quality.fit(docs)
    rows = quality.score(docs, model).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, plain(t or "")[0]) for i, t in EDGE)
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in rows if r.kept)
    empty = docs_of([])
    assert quality.score(empty, quality.fit(empty)).count() == 0
