"""Removal of byte strings that start earlier in the corpus, through suffix arrays.

A byte goes if a string of `size` bytes covers it that also starts earlier: in a document with a
smaller id, or before it in the same document. Strings are judged on the input.

1. Copies of whole texts go at once: only the first one's strings need sorting.
2. In each string of `size` bytes the least-hashed part of 32 bytes is its anchor; equal strings
   have equal anchors at equal places. Anchors found once cannot belong to a repeated string.
3. Around each other anchor, the strings it stands for are cut out and meet at its hash. A task
   sorts their suffixes in two stages and reads common prefixes of neighbours: within a run of
   prefixes of `size` bytes or more, all but the earliest start repeat an earlier string.

Equal cuttings are reduced to their first before they are sent. An anchor of very many places
spreads its strings by their own hashes, so no task gathers what one popular passage touches.

Null texts are empty and lose nothing. Rows with null doc_id take no part and lose nothing.
Rows that repeat a doc_id are one document and must repeat its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pixelmill.llm.encoding import gather
from pixelmill.llm.suffixes import common_prefixes, suffix_array
from pixelmill.llm.tables import small_batches
from pixelmill.llm.textarrays import Texts, mix, slices, texts_of

SIZE = 100
PART = 32
#: An anchor with more places than this sends single strings, each by its own hash.
SPREAD = 4096
#: A chunk holds about a hundred bytes for each of its own while it is sorted.
CHUNK_BYTES = 1 << 19
_PLACES = 1 << 22
#: Places that are searched for anchors at once: a dozen numbers for each.
PIECE = 1 << 18


def anchors(texts: Texts, size: int) -> tuple[np.ndarray, ...]:
    """For each anchor: hash, text, and the first and last start of the strings it stands for."""
    found = []
    width = size - PART + 1
    for at in range(0, len(texts.data), PIECE):
        # A piece with the bytes its last strings need; places count from its begin.
        stop = min(len(texts.data), at + PIECE + size - 1)
        n = stop - at - PART + 1
        if n < width:
            continue
        begins = np.arange(at, at + n)
        hashes = texts.hash(begins, begins + PART)
        least = hashes & ~np.uint64(_PLACES - 1) | np.arange(n, dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(texts.offsets, starts, "right") - 1
        whole = starts + size <= texts.offsets[text + 1]
        starts, text, anchor = starts[whole], text[whole], at + (least[whole] & np.uint64(_PLACES - 1)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        found.append((hashes[anchor[first] - at], text[first], starts[first], starts[last]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat a doc_id of their batch or the last one before it. Repeated rows mostly lie together; what is left of them meets later."""
    last = None
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        new = np.zeros(len(ids), bool)
        new[np.unique(ids, return_index=True)[1]] = True
        if last is not None:
            new &= ids != last
        if len(ids):
            last = ids[-1]
        yield batch if new.all() else batch.filter(pa.array(new))


def _places(size: int):
    """Rows (anchor, doc_id, start, n): n strings from `start` on have this anchor."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_once(batches), "text"):
            texts = texts_of(part.column(1))
            anchor, text, first, last = anchors(texts, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), part.column(0).take(pa.array(text)), pa.array(first - texts.offsets[text]), pa.array((last - first + 1).astype(np.int32))],
                ["anchor", "doc_id", "start", "n"],
            )
    return rows


def _cuttings(size: int):
    """Rows (key, doc_id, start, n, bytes): the bytes of n strings; null bytes if an equal cutting came earlier."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_once(batches), "text"):
            texts = texts_of(part.column(1))
            where = part.column(2).flatten()
            key, start, n, places = (where.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            text = np.repeat(np.arange(len(texts)), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
            start, key = start + texts.offsets[text], key.view(np.uint64)
            # Popular anchors: one cutting for each string.
            copies = np.where(places > SPREAD, n, 1)
            row = np.repeat(np.arange(len(key)), copies)
            step = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            key, text, start, n = key[row], text[row], start[row] + step, np.where(copies > 1, 1, n)[row]
            body = texts.hash(start, start + n + size - 1)
            key = np.where(places[row] > SPREAD, mix(body + np.uint64(7)), key) if len(row) else key
            ids = part.column(0).to_numpy(zero_copy_only=False)[text]
            begin = start - texts.offsets[text]
            order = np.lexsort((begin, ids, body, key))
            same = np.zeros(len(order), bool)
            same[1:] = (body[order][1:] == body[order][:-1]) & (key[order][1:] == key[order][:-1])
            # A cutting of a repeated row is the same place again, no repeat.
            copy = same.copy()
            copy[1:] &= (ids[order][1:] == ids[order][:-1]) & (begin[order][1:] == begin[order][:-1])
            order, same = order[~copy], same[~copy]
            by_place = np.argsort(order)
            rows_kept, again = order[by_place], same[by_place]
            key, ids, begin, start, n = (x[rows_kept] for x in (key, ids, begin, start, n))
            # What came earlier needs no meeting: it is sent by its document.
            key = np.where(again, mix(ids.astype(np.uint64)), key)
            data, edges = gather(texts.data, start, np.where(again, 0, n + size - 1))
            valid = np.packbits(~again, bitorder="little")
            cut = pa.BinaryArray.from_buffers(pa.binary(), len(again), [pa.py_buffer(valid), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(begin), pa.array(n.astype(np.int32)), cut],
                ["key", "doc_id", "start", "n", "bytes"],
            )
    return rows


def _runs(doc: np.ndarray, begin: np.ndarray, row: np.ndarray, size: int) -> pa.RecordBatch:
    """Neighbouring starts of repeated strings as spans of bytes."""
    new = np.ones(len(begin), bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(begin[first]), pa.array(begin[last] + size)], ["doc_id", "start", "end"])


def _later_starts(table: pa.Table, size: int) -> pa.RecordBatch:
    """The spans in which strings start that start earlier, too; rows come by key, doc_id, start."""
    table = table.combine_chunks()
    batch = table.to_batches()[0]
    key, doc, begin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "start"))
    # Cuttings of repeated rows that other tasks sent.
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1])
    if not new.all():
        batch, doc, begin = batch.filter(pa.array(new)), doc[new], begin[new]
    n = batch.column("n").to_numpy(zero_copy_only=False)
    held = texts_of(batch.column("bytes"))
    starts, ends = held.offsets[:-1], held.offsets[1:]
    order = suffix_array(held.data, starts, ends, n.astype(np.int64), size)
    run = np.cumsum(common_prefixes(held.data, order, size) < size) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(np.diff(run, prepend=-1)))
    later = np.sort(order[order != first[run]])
    row = np.searchsorted(starts, later, "right") - 1
    return _runs(doc[row], begin[row] + later - starts[row], row, size)


def _sorted_chunks(size: int):
    """Spans (doc_id, start, end) of repeated strings; a chunk ends where the key changes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        amount = 0
        for batch in batches:
            gone = batch.filter(batch.column("bytes").is_null())
            if gone.num_rows:
                start, n = (gone.column(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                yield pa.RecordBatch.from_arrays([gone.column("doc_id"), pa.array(start), pa.array(start + n + size - 1)], ["doc_id", "start", "end"])
            batch = batch.filter(batch.column("bytes").is_valid())
            for part in slices([batch], "bytes", CHUNK_BYTES // 4):
                held.append(part)
                amount += part.column("bytes").nbytes
                if amount < CHUNK_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield _later_starts(table.slice(0, cut), size)
                    held = table.slice(cut).combine_chunks().to_batches()
                    amount = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield _later_starts(pa.Table.from_batches(held), size)
    return rows


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, spans): the spans of each document that repeat earlier strings, as found: in no order, overlapping.

    `docs` has doc_id long and text; documents without such a span are not in the result.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    names = docs.select("doc_id", F.md5("text").alias("name"), F.octet_length("text").cast("long").alias("bytes")).filter(F.col("bytes") >= size)
    first = names.groupBy("name").agg(F.min("doc_id").alias("first"))
    copies = names.join(first, "name").filter("doc_id > first").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end"))
    unique = docs.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    places = unique.mapInArrow(_places(size), "anchor long, doc_id long, start long, n int")
    shared = places.withColumn("places", F.count("*").over(Window.partitionBy("anchor"))).filter("places > 1")
    by_doc = shared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", "places")).alias("where"))
    cuttings = docs.join(by_doc, "doc_id").select("doc_id", "text", "where").mapInArrow(_cuttings(size), "key long, doc_id long, start long, n int, bytes binary")
    met = cuttings.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    spans = met.mapInArrow(_sorted_chunks(size), "doc_id long, start long, end long")
    return spans.union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _with_spans(docs: DataFrame, size: int, name: str = "spans") -> DataFrame:
    """`docs` with its spans in the column `name`. Rows with an id take the same path to it as in repeated_spans, so their texts are shuffled once."""
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, size).withColumnRenamed("spans", name)
    named = docs.filter("doc_id IS NOT NULL").join(spans, "doc_id", "left").select(*docs.columns, name)
    other = docs.filter("doc_id IS NULL").withColumn(name, F.lit(None).cast(named.schema[name].dataType))
    return named.unionByName(other)


def _merged(spans: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """The maximal removed runs, in order."""
    out: list[tuple[int, int]] = []
    items = spans.values if spans.is_valid else []
    if len(items):
        start, end = (items.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
        last = np.append(new[1:], len(start)) - 1
        out = [(int(a), int(min(b, length))) for a, b in zip(start[new], end[last], strict=True)]
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, the removed runs and the remaining bytes."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    kind = T.StructType.fromDDL(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in slices(batches, "text"):
            texts = texts_of(part.column(1))
            removed, kept = [], []
            for k, spans in enumerate(part.column(2)):
                raw = texts.data[texts.offsets[k] : texts.offsets[k + 1]]
                runs = _merged(spans, len(raw))
                stay = np.ones(len(raw), bool)
                for a, b in runs:
                    stay[a:b] = False
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(raw[stay].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(texts.offsets)), pa.array(removed, out_type), pa.array(kept, pa.binary())], kind.names,
            )

    return _with_spans(docs, size).mapInArrow(rows, kind)


def drop_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`docs` with the repeated strings taken out of `text`, and n_chars counted anew.

    A character goes only if all its bytes do, so that texts stay valid. Texts left blank go with
    their rows; null texts stay.
    """
    columns, name = docs.columns, "spans"
    while name in columns:
        name += "_"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, stay_rows, new, chars = texts_of(part.column("text")), [], [], []
            for k, spans in enumerate(part.column(name)):
                raw = texts.data[texts.offsets[k] : texts.offsets[k + 1]]
                runs = _merged(spans, len(raw))
                head = (raw & 0xC0) != 0x80
                stay = np.ones(len(raw), bool)
                for a, b in runs:
                    stay[a:b] = False
                if runs:  # a character with any byte left stays whole
                    which = np.cumsum(head) - 1
                    stay = (np.bincount(which, stay, minlength=1) > 0)[which]
                body = raw[stay].tobytes()
                stay_rows.append(not runs or bool(body.strip()))
                new.append(body if part.column("text")[k].is_valid else None)
                chars.append(int((stay & head).sum()))
            out = part.set_column(part.schema.get_field_index("text"), "text", pa.array(new, pa.binary()).cast(pa.string()))
            if "n_chars" in columns:
                out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pa.array(chars).cast(part.schema.field("n_chars").type))
            yield out.filter(pa.array(stay_rows, pa.bool_())).select(columns)

    return _with_spans(docs, size, name).mapInArrow(rows, docs.schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT DISTINCT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM raw WHERE len(h) >= 200)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM starts) WHERE k > 1
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
      SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY doc_id, g
), cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM runs GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE substring(h, 1, 2 * s[1]) || array_to_string([substring(h, 2 * e[i] + 1, 2 * (coalesce(s[i + 1], len(h) // 2) - e[i])) for i in range(1, len(s) + 1)], '') END)) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
"""
