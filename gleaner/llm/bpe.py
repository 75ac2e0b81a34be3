"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

Bytes are mapped to the 256 characters of Latin-1, so that an Aho-Corasick automaton over strings
finds the tokens that start at each place. Encoding takes the longest token at the present place
that is compatible with the token before it, goes to shorter ones when it is not, and takes the
last token back when none is left; each place is given up once at most, which keeps the work
linear. Two adjacent tokens are compatible if undoing their merges step by step never meets a pair
that BPE would have merged earlier; the answers are remembered for each pair.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tasks import column, slices, utf8

#: Pieces and pairs whose ids a worker remembers.
PIECE_MEMO, PAIR_MEMO = 500_000, 500_000
#: Longer pieces are encoded, but not remembered.
LONGEST = 64


class BytePairs:
    """A vocabulary of byte strings with ranks, and the split pattern that goes before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if set(ranks.values()) != set(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must run from 0 without gaps and hold all 256 bytes")
        self.ranks = ranks
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.split_text = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(t, t) for t in range(len(self.tokens))]
        self.prefix: list[int] = [-1] * len(self.tokens)
        self._learn_merges()
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "BytePairs":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def _learn_merges(self) -> None:
        """The pair of which each token is made, and its longest proper prefix that is a token."""
        ranks = self.ranks
        for rank, token in enumerate(self.tokens):
            first = True
            for at in range(len(token) - 1, 0, -1):
                left = ranks.get(token[:at])
                if left is None:
                    continue
                if first:
                    self.prefix[rank], first = left, False
                right = ranks.get(token[at:])
                if right is not None and left < rank and right < rank and self._compatible(left, right, rank):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break

    def _compatible(self, left: int, right: int, below: int = 1 << 62) -> bool:
        """Whether BPE leaves these neighbours as they are, with the merges below a rank."""
        limit, merged, halves = below, self.merged, self.halves
        while True:
            found = merged.get((left, right))
            if found is not None and found < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:  # a byte: nothing to undo on this side
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        """Remembered :meth:`_compatible`."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(left, right)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        size = [0] * len(piece)
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                longest[at], size[at] = rank, length
        tokens, prefix, compatible = self.tokens, self.prefix, self.compatible
        open_ends = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(tokens[token])
            if open_ends[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == len(piece):
                    return out
                at, token = end, longest[end]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= len(tokens[token])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.known
        pieces = self.split_text(text or "")
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        out, room = [], PIECE_MEMO - len(known)
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.merge(utf8(piece)), "<u4").tobytes()
                if len(piece) <= LONGEST and room > 0:
                    known[piece] = ids
                    room -= 1
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id without token is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_VOCABULARIES: dict[tuple[str, str], BytePairs] = {}


def vocabulary(path: str, pattern: str) -> BytePairs:
    """One vocabulary for each worker process."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = BytePairs.from_file(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers in a binary.

    Null and empty texts have no tokens; ids of documents may be null or repeat. Other columns
    are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path, pattern).encode
        for part in slices(batches):
            ids = [encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    wanted = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; null ids give no bytes."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(*names).schema, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path, pattern).decode
        for part in slices(batches):
            texts = [decode(x or b"") for x in part.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)

