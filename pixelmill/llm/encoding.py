"""Token ids by a tokenizer of the `tokenizers` library, each distinct part of a word encoded once in a task.

For tokenizers that lower-case, drop white space, and then take runs of letters, single digits and
runs of other signs, with contractions from an apostrophe on, as units that no merge crosses. A
text's ids are then its units' ids one after another.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from pixelmill.llm.textarrays import Memo, Texts

#: Units remembered by a task; on more, it starts afresh.
KEPT_UNITS = 1_000_000
_GROUP = 256

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts values[start:start + length] one after another, and their edges."""
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1])], edges


def units(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case, starts and ends of parts that encode on their own, and each text's first part.

    Words are cut between a letter and an ASCII sign, either way round, but not after an
    apostrophe. Letters are those of ASCII and of two bytes from C3 to C5; next to any other
    character nothing is cut, since it may combine with its neighbour or join a run of signs.
    Where a special token may stand, whole words stay as they are.
    """
    starts, ends = texts.words
    data = texts.data
    if np.any((data[:-1] == ord("<")) & (data[1:] == ord("|"))):
        return texts, starts, ends, texts.first
    texts = texts.lower()
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
    kind[lead] = kind[lead + 1] = _LETTER
    a, b = kind[:-1], kind[1:]
    cut = np.flatnonzero((a == _LETTER) & (b == _SIGN) | (a == _SIGN) & (b == _LETTER) & (data[:-1] != ord("'"))) + 1
    cut = cut[~np.isin(cut, texts.offsets)]
    starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    return texts, starts, ends, np.searchsorted(starts, texts.offsets)


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes units by the tokenizer file at `path`, as 32-bit ids in bytes.

    Units of letters are encoded many at a time, with blanks between. Each ends in one token that
    ends a word; should a group's number of those differ, its units are encoded one by one.
    """
    loaded = Memo()

    def encode(words: list[str]) -> list[bytes]:
        if not loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            loaded["tokenizer"] = Tokenizer.from_file(path)
            vocabulary = loaded["tokenizer"].get_vocab()
            loaded["last"] = np.zeros(max(vocabulary.values()) + 1, bool)
            loaded["last"][[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        out: list[bytes] = [b""] * len(words)
        letters = [k for k, word in enumerate(words) if word.isalpha()]
        single = [k for k, word in enumerate(words) if not word.isalpha()]
        groups = [letters[k : k + _GROUP] for k in range(0, len(letters), _GROUP)]
        batch = lambda texts: loaded["tokenizer"].encode_batch_fast(texts, add_special_tokens=False)
        for group, found in zip(groups, batch([" ".join(words[k] for k in g) for g in groups]), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(loaded["last"][ids]) + 1
            if len(ends) != len(group):
                single += group
                continue
            raw, begin = ids.tobytes(), 0
            for k, end in zip(group, (4 * ends).tolist(), strict=True):
                out[k] = raw[begin:end]
                begin = end
        for k, found in zip(single, batch([words[k] for k in single]), strict=True):
            out[k] = np.array(found.ids, np.uint32).tobytes()
        return out

    return encode


class WordIds:
    """The ids of texts, from an encoder of units and what it gave before."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.known = encode, {}

    def __call__(self, texts: Texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the edges of each text's; `end` is an id put after each text."""
        texts, starts, ends, first = units(texts)
        names, where, which = np.unique(texts.hash(starts, ends), return_index=True, return_inverse=True)
        names = names.tolist()
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        new = [k for k, name in enumerate(names) if name not in self.known]
        raw = texts.data.tobytes()
        for k, ids in zip(new, self.encode([raw[starts[where[k]] : ends[where[k]]].decode() for k in new]), strict=True):
            self.known[names[k]] = ids
        found = [self.known[name] for name in names]
        if end is not None:
            found.append(np.uint32(end).tobytes())
            which = np.insert(which, first[1:], len(names))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.concatenate([[0], np.cumsum(lengths)])
        ids, edges = gather(np.frombuffer(b"".join(found), np.uint32), begin[which], lengths[which])
        per_text = first + (np.arange(len(texts) + 1) if end is not None else 0)
        return ids, edges[per_text]
