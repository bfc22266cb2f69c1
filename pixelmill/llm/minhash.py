"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard similarity on full sets.

A signature needs two permutations of the 2^32 values only. `_sigma` scatters a shingle once;
coordinate k is the least `_pi(sigma + k)`, so the second permutation, shifted around by k, serves
every coordinate. Bands of 4 coordinates make 32 buckets per document: a pair at similarity 0.75
misses all of them once in 190,000 times, and one at 0.8 once in 10 million.

Equal sets are one class from the start. The members of all buckets that have the same least
member form a cell. A cell is compared on full sets by blocks of members, so a hot group becomes
many small tasks, and yields links that join what belongs together, never all pairs.

Null or empty texts, and texts without words, have the empty set: a component each, always kept.
Rows with equal doc_id are one document. A null doc_id takes no part: null component, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pixelmill.llm.graph import components
from pixelmill.llm.tables import stage
from pixelmill.llm.textarrays import Texts, mix, repeated, slices, texts_of, windows

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: Members of a cell that are compared with as many others in one group.
BLOCK = 256


def shingles(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as (text, hash), texts in order.

    A text with fewer words is one shingle as a whole.
    """
    texts = texts.lower()
    hashes, owner, n_words = texts.word_hashes, texts.owner, np.diff(texts.first)
    runs = windows(hashes, words)
    at = np.flatnonzero(owner[: len(runs)] == owner[words - 1 :]) if len(runs) else np.zeros(0, np.int64)
    own, value = [owner[at]], [runs[at]]
    for n in range(1, words):
        short = np.flatnonzero(n_words == n)
        if len(short):
            own.append(short)
            value.append(mix(windows(hashes, n)[texts.first[short]] + np.uint64(n)))
    who, what = np.concatenate(own), np.concatenate(value)
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    _, later = repeated(mix(what + mix(who.astype(np.uint64) + np.uint64(1))))
    return who[~later], what[~later]


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _sigma(shingle: np.ndarray) -> np.ndarray:
    """The other permutation, of the shingles' 32-bit names."""
    return _pi((mix(shingle) >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))


def signatures(starts: np.ndarray, shingle: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of the sets that begin at `starts`; one row per set."""
    place = _sigma(shingle)
    out = np.empty((len(starts), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_pi(place + np.uint32(k)), starts)
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature; bands never share one."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): the set's size, 128-bit name and buckets."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            who, what = shingles(texts_of(part.column(1)))
            size = np.bincount(who, minlength=part.num_rows)
            full = np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size[full])])
            name = np.zeros((2, part.num_rows), np.uint64)
            bands = np.zeros((0, BANDS), np.uint64)
            if len(full):
                name[0, full] = np.add.reduceat(mix(what), starts[:-1])
                name[1, full] = np.bitwise_xor.reduceat(mix(what + np.uint64(1)), starts[:-1])
                bands = band_hashes(signatures(starts[:-1], what))
            ends = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)), pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit shingles as bytes, of the wanted documents."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            who, what = shingles(texts_of(part.column(1)))
            cut = np.searchsorted(who, np.arange(part.num_rows + 1))
            sets = [np.sort(what[cut[k] : cut[k + 1]]).tobytes() for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    # The same join at every size: the wanted ids grow with the corpus.
    return docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(rows, "doc_id long, shingles binary")


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all sets which chains of similar sets join: a forest, not all pairs."""
    size = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    common = both.astype(np.int64)
    good = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    out, left = [], np.ones(len(sets), bool)
    for k in range(len(sets)):
        front = [k] if left[k] else []
        left[k] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(good[at] & left)
            left[new] = False
            out.extend((at, int(j)) for j in new)
            front.extend(new.tolist())
    return out


def _similar(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each cell, found on the full sets.

    A cell of many members is split into blocks, and each two blocks meet in a group of their own,
    so a group has at most two blocks of members whatever the cell.
    """
    size = cells.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        cells.join(size, "center").withColumn("own", own).withColumn("other", other)
        .select("rep", F.xxhash64("center", F.least("own", "other"), F.greatest("own", "other")).alias("meet"))
    )
    met = placed.join(sets, placed["rep"] == sets["doc_id"]).select("meet", "rep", "shingles").repartition("meet").sortWithinPartitions("meet", "rep")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            pairs = _links([s for _, s in group], percent) if len(group) > 1 else []
            a, b = ([group[p[k]][0] for p in pairs] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, group = None, []
        for batch in batches:
            for meet, rep, shingle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if meet != now and group:
                    yield done(group)
                    group = []
                now = meet
                group.append((rep, np.frombuffer(shingle.as_py(), np.uint64)))
        if group:
            yield done(group)

    return met.mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drawn = stage(sketches(docs))
    classes = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    members = stage(
        drawn.join(classes, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    )
    entries = members.filter("n_shingles > 0 AND doc_id = rep").select(F.explode("bands").alias("bucket"), "rep").distinct()
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).filter("center < last").select("bucket", "center")
    # All that share a bucket share its least member's cell, often with many other buckets.
    cells = stage(entries.join(shared, "bucket").select("center", "rep").distinct())
    sets = _full_sets(docs, cells.select(F.col("rep").alias("doc_id")).distinct())
    labels = components(_similar(cells, sets, percent))
    labels = labels.select(F.col("node").alias("rep"), "component")
    return (
        members.select("doc_id", "n_shingles", "rep").join(labels, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that near_duplicates() keeps."""
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
    FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, b AS other FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = other
), least AS (
  SELECT node, min(other) AS m FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = doc_id
"""
