"""A suffix array by two-stage sorting, of many short texts at once, inside a task.

A suffix is rising if it is smaller than its successor, the suffix one byte later, and else falling. Only rising suffixes
are sorted directly. Falling ones follow by one scan over the buckets of first bytes, smallest
first: the suffix before each sorted one goes to the end of what its own bucket holds so far.
"""

from __future__ import annotations

import numpy as np


def rising(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor. Each text ends (at `ends`) with a smallest byte."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[ends - 1] = -1
    # A run of equal bytes rises or falls as the first different byte after it says.
    decided = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return step[decided] > 0


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The first counts[k] suffixes of each text data[starts[k]:ends[k]], sorted by `depth` bytes.

    Suffixes after these take part as far as the scan needs them: up to the next rising one.
    """
    up = rising(data, ends)
    text_of = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(len(data))
    wanted = place - starts[text_of] < counts[text_of]
    # The next rising suffix from each place on, or the end of the text.
    stop = np.where(up, place, len(data))
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends[text_of])
    part = place <= stop[starts + counts - 1][text_of]

    seeds = np.flatnonzero(part & up)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[seeds]
    seeds = seeds[np.argsort(keys.view(f"S{depth}").ravel(), kind="stable")]
    cuts = np.searchsorted(data[seeds], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True

    def before(places: np.ndarray) -> np.ndarray:
        """The suffixes one byte longer than those at `places`, as far as they take part."""
        places = places[~begins[places]] - 1
        return places[part[places]]

    def send(suffixes: np.ndarray) -> None:
        """Puts suffixes at the end of what their buckets hold, in this order."""
        first = data[suffixes]
        order = np.argsort(first, kind="stable")
        suffixes, first = suffixes[order], first[order]
        for group in np.split(suffixes, np.flatnonzero(np.diff(first)) + 1) if len(suffixes) else ():
            waiting[data[group[0]]].append(group)

    # The ends of the texts are smaller than all else, so what falls up to an end comes first.
    last = ends - 1
    send(last[part[last]])
    out = []
    for c in range(256):
        placed = [*waiting[c]]
        front = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        while len(front):  # runs of this byte, one step longer each time
            front = before(front)
            front = front[data[front] == c]
            if len(front):
                placed.append(front)
        bucket = np.concatenate([*placed, seeds[cuts[c] : cuts[c + 1]]])
        if len(bucket):
            out.append(bucket)
            longer = before(bucket)
            send(longer[data[longer] > c])
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[wanted[found]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to `depth`, of each suffix in `order` with the one before it (0 for the first)."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    word = np.zeros(len(data) + depth + 8, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(word)]
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = word[order[alive] + at] ^ word[order[alive - 1] + at]
        out[alive] += 8
        for k in range(8):  # a difference in the byte k places from the right leaves 7 - k equal bytes
            out[alive[differ >= np.uint64(1 << 8 * k)]] -= 1
        alive = alive[differ == 0]
    return np.minimum(out, depth)
