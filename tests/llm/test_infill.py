"""Fill-in-the-middle against plain Python and SQL."""

import hashlib
import random
import re

import numpy as np
import pytest

from pixelmill.llm import infill
from pixelmill.llm.queries import ORACLE, QUERIES
from pixelmill.llm.textarrays import Texts

from compare import connect, difference
from conftest import SF
from llm_cases import EDGE, docs_of  # noqa: F401


def plain_way(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < spm:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(n):
    rng = random.Random(4)
    pieces = ["\n", "a", "<", "P", ">", "é", "日", "\U0001f600", "\r\n", "word ", "<P", "S>", "\t"]
    return [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(100, 100 + n)]


MARKED = [(20, "a\n<P>\nb"), (21, "<M>"), (22, "x<S>"), (23, "<p>\n<Q>\n"), (24, "\n"), (25, "\n\n\n"), (26, "no end"), (27, "<\n<\n<\n"), (28, ">\nP>\nM>\n"), (29, "a\n" * 5000)]


@pytest.mark.parametrize("window,rate,spm", [(1 << 20, 100, 50), (7, 100, 50), (1000, 60, 20), (1 << 20, 0, 50)])
def test_every_row_equals_plain_python(docs_of, monkeypatch, window, rate, spm):  # noqa: F811
    monkeypatch.setattr(infill, "WINDOW", window)
    rows = MARKED + texts(60) + ([] if window == 7 else EDGE)
    made = infill.restore(infill.fill_in_middle(docs_of(rows), rate=rate, spm_rate=spm))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode()) for r in made.collect())
    want = sorted((i if i is not None else -1, *plain_way(i, t, rate=rate, spm=spm), t or "") for i, t in rows)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)


def test_scatter_and_gather_in_small_windows(monkeypatch):
    rng = np.random.default_rng(0)
    for window in (1, 3, 64):
        monkeypatch.setattr(infill, "WINDOW", window)
        for _ in range(30):
            sizes = rng.integers(0, 9, 6)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = rng.integers(97, 100, offsets[-1]).astype(np.uint8)
            form = rng.integers(0, 3, 6)
            cut = offsets[:-1] + (rng.random(6) * (sizes + 1)).astype(int)
            end = cut + (rng.random(6) * (offsets[1:] - cut + 1)).astype(int)
            out = infill.rearrange(Texts(data, offsets), cut, end, form)
            for k in range(6):
                p, m, s = (bytes(data[a:b]) for a, b in ((offsets[k], cut[k]), (cut[k], end[k]), (end[k], offsets[k + 1])))
                assert bytes(out.data[out.offsets[k] : out.offsets[k + 1]]) == [p + m + s, b"<P>" + p + b"<S>" + s + b"<M>" + m, b"<S>" + s + b"<P>" + p + b"<M>" + m][form[k]]
            back = infill.put_back(out, form)
            assert (back.data == data).all() and (back.offsets == offsets).all()


def test_no_rows(docs_of):  # noqa: F811
    assert infill.restore(infill.fill_in_middle(docs_of([]))).collect() == []


def test_query_equals_sql(spark):
    assert difference(QUERIES["op13_fill_in_middle"](spark, SF), connect(SF), ORACLE["op13_fill_in_middle"]) is None
