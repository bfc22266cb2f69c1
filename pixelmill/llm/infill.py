"""Fill-in-the-middle: texts cut into lines, rearranged, and put back.

The bytes of many texts lie in one buffer. A scan of the line ends gives the cuts; a difference
array holds, where a part begins, by how much its displacement differs from that of the byte before;
its running sum is every byte's displacement, and one scatter writes all outputs. Restoring finds
the marks in the outputs, builds the same displacements and gathers.

`unit`: a line with its newline. With n units, the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) of them and the middle after the larger; h1 to h4 come from sha256 of `seed:doc_id`. The form
is psm (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle), or plain (the
text itself) if the text is empty, holds a mark, or is not chosen.

Null texts are empty ones. A null doc_id is hashed as the word null. Each row is worked on by itself,
so repeated rows give repeated results; an empty table gives an empty one. Other columns do not
travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelmill.llm.textarrays import Texts, slices, texts_of

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FORMS = ("plain", "psm", "spm")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes that are displaced at once: the index arrays of a long text stay this small.
WINDOW = 1 << 20


def hash_parts(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of 8 hex digits of the sha256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marks_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks, and their letters."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], [ord(x) for x in MARKS]))
    return at, data[at + 1]


def _owned(texts: Texts, at: np.ndarray, size: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and whether `size` bytes from there lie in that text."""
    owner = np.searchsorted(texts.offsets, at, "right") - 1
    return owner, at + size <= texts.offsets[owner + 1]


def line_ends(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all lines, text by text, and where each text's first one stands among them."""
    ends = np.flatnonzero(texts.data == 10) + 1
    start, stop = texts.offsets[:-1], texts.offsets[1:]
    open_end = stop > start
    open_end[open_end] = texts.data[stop[open_end] - 1] != 10
    ends = np.sort(np.concatenate([ends, stop[open_end]]))
    return ends, np.searchsorted(ends, texts.offsets, "right")


def _moved(n: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For windows of the n bytes: start, end, and where each byte is displaced to.

    `starts` are the sorted beginnings of parts (empty parts may share one; the last counts), `shifts`
    their displacements.
    """
    step = np.diff(shifts, prepend=0)
    now = 0
    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        lo, hi = np.searchsorted(starts, (a, b))
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[lo:hi] - a, step[lo:hi])
        change[0] += now
        shift = np.cumsum(change)
        now = int(shift[-1])
        yield a, b, np.arange(a, b) + shift


def rearrange(texts: Texts, cut: np.ndarray, end: np.ndarray, form: np.ndarray) -> Texts:
    """The outputs: `cut` and `end` are where the middle begins and ends, `form` numbers into FORMS."""
    start, stop = texts.offsets[:-1], texts.offsets[1:]
    made = form > 0
    offsets = np.concatenate([[0], np.cumsum(stop - start + 9 * made)])
    base, psm = offsets[:-1], form == 1
    pre, mid, suf = cut - start, end - cut, stop - end
    # Where the marks and the parts go.
    p_mark = np.where(psm, base, base + 3 + suf)
    s_mark = np.where(psm, base + 3 + pre, base)
    m_mark = base + 6 + pre + suf
    to = np.stack([np.where(made, p_mark + 3, base), np.where(made, m_mark + 3, base + pre), np.where(made, s_mark + 3, base + pre + mid)], 1)
    begins = np.stack([start, cut, end], 1)
    out = np.empty(offsets[-1], np.uint8)
    for letter, at in zip("PSM", (p_mark, s_mark, m_mark)):
        out[(at[made, None] + np.arange(3)).ravel()] = np.tile(np.frombuffer(MARKS[letter], np.uint8), int(made.sum()))
    for a, b, place in _moved(len(texts.data), begins.ravel(), (to - begins).ravel()):
        out[place] = texts.data[a:b]
    return Texts(out, offsets)


def put_back(outputs: Texts, form: np.ndarray) -> Texts:
    """The texts that rearrange() was given, from its outputs and forms alone."""
    made = form > 0
    at, letter = marks_in(outputs.data)
    owner, inside = _owned(outputs, at, 3)
    good = inside & made[owner]
    at, letter, owner = at[good], letter[good], owner[good]
    where = {x: np.zeros(len(outputs), np.int64) for x in MARKS}
    for x in MARKS:
        where[x][owner[letter == ord(x)]] = at[letter == ord(x)]
    start, stop = outputs.offsets[:-1], outputs.offsets[1:]
    psm = form == 1
    pre = np.where(made, np.where(psm, where["S"], where["M"]) - where["P"] - 3, 0)
    mid = np.where(made, stop - where["M"] - 3, 0)
    suf = np.where(made, np.where(psm, where["M"], where["P"]) - where["S"] - 3, stop - start)
    offsets = np.concatenate([[0], np.cumsum(pre + mid + suf)])
    begins = offsets[:-1, None] + np.stack([np.zeros_like(pre), pre, pre + mid], 1)
    source = np.stack([np.where(made, where["P"] + 3, start), np.where(made, where["M"] + 3, start), np.where(made, where["S"] + 3, start)], 1)
    text = np.empty(offsets[-1], np.uint8)
    for a, b, place in _moved(len(text), begins.ravel(), (source - begins).ravel()):
        text[a:b] = outputs.data[place]
    return Texts(text, offsets)


def _binary(texts: Texts) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(texts.offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(texts.data))]).cast(pa.binary())


_MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def _filled(batches: Iterator[pa.RecordBatch], rate: int, spm_rate: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        texts = texts_of(part.column("text"))
        h = [part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        ends, first = line_ends(texts)
        n = np.diff(first)
        at, _ = marks_in(texts.data)
        owner, inside = _owned(texts, at, 3)
        plain = (np.diff(texts.offsets) == 0) | (h[2] % 100 >= rate)
        plain[owner[inside]] = True
        form = np.where(plain, 0, np.where(h[3] % 100 < spm_rate, 2, 1))
        one, two = h[0] % (n + 1), h[1] % (n + 1)
        edges = []
        for units in (np.minimum(one, two), np.maximum(one, two)):
            # After `units` lines: the text's start, or the end of the last of them.
            last = ends[np.maximum(first[:-1] + units - 1, 0)] if len(ends) else texts.offsets[:-1]
            edges.append(np.where(units > 0, last, texts.offsets[:-1]))
        chars = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=chars[1:])
        cut, end = edges
        out = rearrange(texts, cut, end, form)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()),
             pa.array(chars[cut] - chars[texts.offsets[:-1]], mask=plain), pa.array(chars[end] - chars[cut], mask=plain), _binary(out)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "output"):
        form = np.array([FORMS.index(x) for x in part.column("form").to_pylist()], np.int64)
        text = put_back(texts_of(part.column("output")), form)
        yield pa.RecordBatch.from_arrays([*part.columns, _binary(text)], [*part.schema.names, "restored"])


def _given(docs: DataFrame, seed: int) -> DataFrame:
    parts = [x.alias(f"h{k}") for k, x in enumerate(hash_parts(F.col("doc_id"), seed), 1)]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *parts)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output (bytes)."""
    return _given(docs, seed).mapInArrow(lambda batches: _filled(batches, rate, spm_rate), _MADE)


def restore(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with `restored`, the text (bytes) rebuilt from `output` and `form`."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in made.schema)}, restored binary"
    return made.mapInArrow(_restored, schema)


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """fill_in_middle() and restore() one after the other in the same task, with sha256 digests in place of the texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _restored(_filled(batches, rate, spm_rate)):
            sums = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in part.column(c)], pa.string()) for c in ("output", "restored")]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], *sums], [*part.schema.names[:5], "output_sha256", "restored_sha256"])

    return _given(docs, seed).mapInArrow(rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS s
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
