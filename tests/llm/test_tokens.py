"""Packing, token counts, encoding and decoding, and top-k search."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from compare import connect, difference
from pixelmill.llm import nearest, packing, unigram
from pixelmill.llm.encoding import word_encoder
from pixelmill.llm.queries import ORACLE, QUERIES

from conftest import SF
from llm_cases import EDGE, corpus, docs_of  # noqa: F401

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, capacity):
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
        assert filled[r.sequence_id] <= capacity
    return len(filled)


def test_pieces_and_packing(spark, corpus):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {}
    for i, text in corpus.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], np.uint32)
        for at in range(0, len(ids), 2048):
            want[(i, at // 2048)] = (at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048]))
    rows = QUERIES["op3_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    least = -(-sum(n for _, n, _ in want.values()) // 2048)
    assert check_packing(rows, 2048) <= 1.03 * least + 1


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 60))
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, rng.integers(2, 50), capacity) * (rng.random(capacity) < rng.random())
    plan = packing.Plan(counts, capacity, int(rng.integers(1, 9)), int(rng.integers(0, capacity)))
    length = np.repeat(np.arange(capacity + 1), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    if len(length):
        sequence, offset = plan.find(length, rank)
        filled = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
            assert filled.get(s, 0) == o
            filled[s] = o + n
        assert sorted(filled) == list(range(plan.sequences)) and max(filled.values()) <= capacity


def test_packing_edge_cases(docs_of):
    rows = packing.pack(docs_of(EDGE), word_encoder(WORD_BPE), with_ids=True).collect()
    assert sorted((r.doc_id or 0) for r in rows if r.piece == 0) == sorted(i or 0 for i, _ in EDGE)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, np.uint32)) == r.ids_crc32 for r in rows)
    assert all(r.length == 1 and r.ids == [0] for r in rows if r.doc_id in (1, 2, 3))
    check_packing(rows, 2048)
    assert packing.pack(docs_of([]), word_encoder(WORD_BPE)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_and_ids_equal_plain_segmentation(spark, corpus, pieces):
    """Against the unigram model of another library with the same pieces and scores, word by word."""
    by_id = {k: (p, s) for p, (s, k) in pieces.pieces.items()}
    plain = models.Unigram([("<unk>", 0.0), *((p, s) for p, (s, _) in pieces.pieces.items()), *(("<0x%02X>" % b, -1e4) for b in range(256))], 0, True)
    words = sorted({"▁" + w for t in corpus.values() for w in t.split(" ") if "\n" not in w})[:20_000]
    trie = unigram.CountingTrie(pieces)
    for word, ids in zip(words, unigram.encode_sorted(words, pieces), strict=True):
        tokens = [t.value for t in plain.tokenize(word)]
        assert len(ids) == len(tokens) == trie.count(word)
        assert sum(by_id[k][1] for k in ids if k in by_id) == pytest.approx(sum(pieces.pieces[t][0] for t in tokens if t in pieces.pieces))


def test_queries_count_and_decode_alike(spark, corpus):
    coded = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, SF).collect()}
    assert {i: r.text_sha256 for i, r in coded.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in corpus.items()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, SF).collect()} == {i: r.n_tokens for i, r in coded.items()}


def test_token_edge_cases(docs_of, pieces, monkeypatch):
    monkeypatch.setattr(unigram, "KEPT_WORDS", 50)
    monkeypatch.setattr(unigram, "KEPT_NODES", 50)
    cases = [*EDGE, (20, "  a ▁b\n\n c\t日本語 \U0001f600 x\n"), (21, "▁"), (22, "\n"), (23, " "), (24, "\udfff".encode("utf-16", "surrogatepass").decode("utf-16", "replace"))]
    docs = docs_of(cases)
    rows = unigram.decode(unigram.encode(docs, pieces), pieces).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((i or 0, t or "") for i, t in cases)
    counts = unigram.token_counts(docs, pieces).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counts) == sorted((r.doc_id or 0, len(r.ids)) for r in rows)
    assert unigram.encode(docs_of([]), pieces).count() == 0 and unigram.token_counts(docs_of([]), pieces).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


@pytest.mark.parametrize("blocks,queries", [(65_536, 16_384), (40, 3)])
def test_top_k_with_ties_and_bad_vectors(spark, monkeypatch, blocks, queries):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(nearest, "QUERY_ROWS", queries)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)] + [(300, None), (350, [1.0, None] * 3), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, 1.0]), (550, []), (0, rows[0][1]), (7, rows[7][1])]
    good = {i: [int(np.floor(256 * np.float32(x).astype(float))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    found = nearest.top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert nearest.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    data = [rng.normal(size=4) * 10 + rng.integers(-3, 4, 4) * 20 for _ in range(300)]
    cells = nearest.choose_pivots(data, 6)
    where = [cells.assign(x) for x in data]
    radius, count = {}, {}
    for k, d in where:
        radius[k], count[k] = max(d, radius.get(k, 0)), count.get(k, 0) + 1
    reach = nearest.lower_bounds(radius, {k: (radius[k], count[k]) for k in radius}, cells, 5)
    for q, (g, _) in zip(data, where):
        assert sorted((float(q @ x) for x in data if x is not q), reverse=True)[4] >= reach[g]


def test_units_encode_like_whole_texts():
    from pixelmill.llm.encoding import WordIds
    from pixelmill.llm.textarrays import texts_of

    import pyarrow as pa

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["Don't stop, it's 3rd! (Éa×b—c.) x÷y ... 'tis o'clock ''s İstanbul ẞ", "a≠b é, ñ.x —. --a 中文,字 1²2 ΣΣ. éÉ,", "plain <|endoftext|> <|ENDOFTEXT|>a and, more", "  nbsp word,x \x1c\x1d y\x85z", "", "\U0001f600,a\U0001f600 ﬁn. ͅa"]
    for text in [*texts, " ".join(t for t in texts if "<|" not in t)]:
        ids, edges = WordIds(word_encoder(WORD_BPE))(texts_of(pa.array([text, "b", text])), 0)
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert ids[: edges[1]].tolist() == want == ids[edges[2] :].tolist()
