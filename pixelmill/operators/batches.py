"""Groups of sorted rows inside a task, as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def changed(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in some column; null equals null."""
    n = len(columns[0]) if columns else 0
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        new[1:] |= pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return new


def met(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with equal keys in one task, side by side and in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that no run of equal keys crosses, and where the runs begin."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest:
            batch = pa.concat_batches([*rest, batch])
        starts = np.flatnonzero(changed([batch.column(k) for k in keys]))
        rest = [batch.slice(int(starts[-1]))]
        if len(starts) > 1:
            yield batch.slice(0, int(starts[-1])), starts[:-1]
    for batch in rest:
        yield batch, np.zeros(1, np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One batch per run of rows with equal keys."""
    for batch, starts in whole_groups(batches, keys):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(values).ravel()))


def joined(made: Iterator[pa.RecordBatch], cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they hold about so many list elements in `v`."""
    wait: list[pa.RecordBatch] = []
    size = 0
    for batch in made:
        wait.append(batch)
        size += len(batch.column("v").values) + batch.num_rows
        if size > cells:
            yield pa.concat_batches(wait)
            wait, size = [], 0
    if wait:
        yield pa.concat_batches(wait)
