"""Words, hashes and lines of many texts at once, as NumPy arrays inside a task.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so it never depends on how a language
classifies characters, and lower-casing touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes: a few arrays of 8 bytes per text byte.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """What a task remembers; it travels to tasks empty."""

    def __reduce__(self):
        return Memo, ()


_POWERS = Memo()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2^64, and of its inverse."""
    if n > _POWERS.get("n", 0):
        size = SLICE_BYTES + 1 if n <= SLICE_BYTES + 1 else n + n // 4
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _POWERS[name] = np.full(size, base, np.uint64)
            _POWERS[name][0] = 1
            np.cumprod(_POWERS[name], out=_POWERS[name])
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Texts:
    """Texts one after another in one byte buffer; text k is data[offsets[k]:offsets[k + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def sums(self) -> np.ndarray:
        """Prefix sums of byte * base^place: the hash of any part follows from two of them."""
        pw, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * pw[: len(self.data)], out=out[1:])
        return out

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; equal parts have equal hashes, also in other slices."""
        _, inverse = _powers(len(self.data) + 1)
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    @cached_property
    def solid(self) -> np.ndarray:
        return ~_BLANK[self.data]

    def lower(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that the mask holds; none crosses the end of its text."""
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        before = np.zeros(len(mask), bool)
        before[1:] = mask[:-1]
        before[inner] = False
        after = np.zeros(len(mask), bool)
        after[:-1] = mask[1:]
        after[inner - 1] = False
        return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(self.solid)

    @cached_property
    def first(self) -> np.ndarray:
        """Words of text k are first[k] up to first[k + 1]."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hash(*self.words)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offsets])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours, in order; shorter input gives none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return out


def texts_of(column: pa.Array) -> Texts:
    """The buffer of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def changes(column: pa.Array) -> np.ndarray:
    """Whether a text differs from the one before it; the first one does."""
    new = np.ones(len(column), bool)
    new[1:] = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return new


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, once: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, and at least one row; `once`: a text that equals the one before it counts nothing."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if once:
            sizes *= changes(batch.column(column))
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line; lines are what a split at newlines gives."""
    cuts = np.flatnonzero(texts.data == 10)
    owner = np.searchsorted(texts.offsets, cuts, "right") - 1
    own = np.concatenate([np.arange(len(texts)), owner])
    starts, ends = np.concatenate([texts.offsets[:-1], cuts + 1]), np.concatenate([texts.offsets[1:], cuts])
    order = np.lexsort((starts, own))
    # Within a text the sorted starts and the sorted ends belong together, one by one.
    return starts[order], ends[np.lexsort((ends, own))], own[order]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs again in the array, and whether it occurred before."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], later[order] = same[:-1] | same[1:], same[:-1]
    return twice, later


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: equal bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
