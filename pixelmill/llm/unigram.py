"""Unigram segmentation over the pieces of a SentencePiece file, words sharing their prefixes.

A text gets one blank in front; each blank begins a marked word (the mark stands for the blank),
and each newline is a word of its own. Both the count and the encoding pick, per word, the pieces
with the largest sum of scores. A file of merges holds ranks in place of probabilities, so a
piece's score is the log probability of its rank by Zipf's law. A character that no piece covers
falls back to its bytes at a penalty; so does a mark sign that a text itself holds, and decoding
gives back every text exactly.

Null and empty texts have no tokens and decode to the empty text. Ties in score go to the longer
last piece. Repeated rows count alike; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pixelmill.llm.encoding import gather
from pixelmill.llm.textarrays import Memo, Texts, slices, texts_of

MARK = "▁"
#: Stands for a mark sign of the text; no text can hold a lone surrogate.
_OWN_MARK = "\udfff"
#: Trie nodes and words a task keeps; on more, it starts afresh.
KEPT_NODES = 700_000
KEPT_WORDS = 700_000


class Pieces:
    """Pieces with ids and scores, as the tasks need them; loads from the file at `path` on first use."""

    def __init__(self, path: str):
        self.path, self.loaded = path, Memo()

    def _load(self) -> Memo:
        if not self.loaded:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            n = model.get_piece_size()
            plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
            ranked = sorted(plain, key=lambda k: (-model.get_score(k), k))
            total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
            raw, held = [b""] * n, set(plain)
            for k in range(n):
                if model.is_byte(k):
                    raw[k] = bytes([int(model.id_to_piece(k)[3:5], 16)])
                elif k in held:
                    raw[k] = model.id_to_piece(k).replace(MARK, " ").encode()
            self.loaded["pieces"] = {model.id_to_piece(k): (-math.log(r + 1) - total, k) for r, k in enumerate(ranked)}
            self.loaded["bytes"] = {raw[k][0]: k for k in range(n) if model.is_byte(k)}
            self.loaded["unknown"] = -math.log(len(ranked)) - total - 10.0
            # Pieces by their characters from the last to the first; "" holds a whole piece's score and id.
            self.loaded["backward"] = {}
            for piece, value in self.loaded["pieces"].items():
                node = self.loaded["backward"]
                for character in reversed(piece):
                    node = node.setdefault(character, {})
                node[""] = value
            self.loaded["raw"] = np.frombuffer(b"".join(raw), np.uint8)
            self.loaded["at"] = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return self.loaded

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self._load()[name]

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if character == _OWN_MARK else character).encode()]


def marked(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one blank in front of each, the starts and ends of their words, and the first word of each text."""
    full = np.flatnonzero(np.diff(texts.offsets))
    data = np.insert(texts.data, texts.offsets[full], 0x20)
    grown = np.zeros(len(texts) + 1, np.int64)
    grown[full + 1] = 1
    out = Texts(data, texts.offsets + np.cumsum(grown))
    begin = (data == 0x20) | (data == 0x0A)
    begin[1:] |= data[:-1] == 0x0A
    starts = np.flatnonzero(begin)
    return out, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, out.offsets)


def _spelled(texts: Texts, start: int, end: int) -> str:
    return texts.data[start:end].tobytes().decode().replace(MARK, _OWN_MARK).replace(" ", MARK)


class CountingTrie:
    """Words with their best segmentation's number of tokens; each prefix is scored once.

    A node holds the best score of its prefix and the tokens it takes, and a word's last node
    thereby holds the word's count.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.backward, self.unknown = pieces, pieces.backward, pieces.unknown
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        child, scores, counts, path, node = self.child, self.score, self.tokens, [0], 0
        for end, character in enumerate(word, 1):
            key = node << 21 | ord(character)
            before, node = node, child.get(key)
            if node is None:
                best, tokens = -math.inf, 0
                part, start = self.backward.get(character), end - 1
                if part is None or "" not in part:
                    best, tokens = scores[before] + self.unknown, counts[before] + len(self.pieces.fallback(character))
                while part is not None:
                    piece = part.get("")
                    if piece is not None and (score := scores[path[start]] + piece[0]) >= best:
                        best, tokens = score, counts[path[start]] + 1
                    start -= 1
                    part = part.get(word[start]) if start >= 0 else None
                node = len(scores)
                child[key] = node
                scores.append(best)
                counts.append(tokens)
            path.append(node)
        return counts[node]


def encode_sorted(words: list[str], pieces: Pieces) -> Iterator[list[int]]:
    """The ids of sorted words, depth first: a word goes on from the prefix it shares with the last one."""
    backward, unknown = pieces.backward, pieces.unknown
    score, step, last = [0.0], [(0, -1)], ""
    for word in words:
        shared = 0
        for x, y in zip(word, last):
            if x != y:
                break
            shared += 1
        del score[shared + 1 :], step[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            part, start = backward.get(word[end - 1]), end - 1
            best, back = -math.inf, (0, -1)
            if part is None or "" not in part:
                best, back = score[start] + unknown, (start, -1)
            while part is not None:
                piece = part.get("")
                if piece is not None and (now := score[start] + piece[0]) >= best:
                    best, back = now, (start, piece[1])
                start -= 1
                part = part.get(word[start]) if start >= 0 else None
            score.append(best)
            step.append(back)
        at, ids = len(word), []
        while at:
            start, piece = step[at]
            ids.extend([piece] if piece >= 0 else reversed(pieces.fallback(word[start])))
            at = start
        last = word
        yield ids[::-1]


def token_counts(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id, its marked words, its tokens. No shuffle: each task counts what it reads."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("n_words long, n_tokens long")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = CountingTrie(pieces), {}
        for part in slices(batches, "text"):
            texts, starts, ends, first = marked(texts_of(part.column(1)))
            names, where, which = np.unique(texts.hash(starts, ends), return_index=True, return_inverse=True)
            if len(trie.score) > KEPT_NODES:
                trie.clear()
            if len(known) > KEPT_WORDS:
                known.clear()
            names = names.tolist()
            for k, name in enumerate(names):
                if name not in known:
                    known[name] = trie.count(_spelled(texts, starts[where[k]], ends[where[k]]))
            counts = np.fromiter((known[name] for name in names), np.int64, len(names))
            total = np.concatenate([[0], np.cumsum(counts[which])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(np.diff(total[first]))], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def encode(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: doc_id and its ids."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("ids array<int>")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bytes] = {}
        for part in slices(batches, "text"):
            texts, starts, ends, first = marked(texts_of(part.column(1)))
            names, where, which = np.unique(texts.hash(starts, ends), return_index=True, return_inverse=True)
            if len(known) > KEPT_WORDS:
                known.clear()
            names = names.tolist()
            new = sorted((_spelled(texts, starts[where[k]], ends[where[k]]), name) for k, name in enumerate(names) if name not in known)
            for (_, name), ids in zip(new, encode_sorted([w for w, _ in new], pieces), strict=True):
                known[name] = np.array(ids, np.int32).tobytes()
            found = [known[name] for name in names]
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin = np.concatenate([[0], np.cumsum(lengths)])
            ids, edges = gather(np.frombuffer(b"".join(found), np.int32), begin[which], lengths[which])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges[first].astype(np.int32)), pa.array(ids))], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("ids").flatten().to_numpy()
                many = part.column("ids").value_lengths().fill_null(0).to_numpy()
                at = pieces.at
                data, edges = gather(pieces.raw, at[:-1][ids], np.diff(at)[ids])
                edges = edges[np.concatenate([[0], np.cumsum(many)])]
                body = data.tobytes()
                out = [body[a + 1 : b].decode() for a, b in zip(edges.tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], schema.names)

    return encoded.mapInArrow(rows, schema)


def _model() -> Pieces:
    return Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _model())


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as a number and a checksum; the decoded text as its hash, which is that of the text itself."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, ids = batch.column("ids").offsets.to_numpy(), batch.column("ids").values.to_numpy()
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64()), batch.column("text")], ["doc_id", "n_tokens", "ids_crc32", "text"])

    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), _model()), _model())
    return coded.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, text string").select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
