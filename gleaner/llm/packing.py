"""Packing token sequences: dominance reduction, then best fit, on counts of lengths.

Documents become pieces of at most ``capacity`` tokens. Which pieces share a sequence depends on
lengths alone, so the instance is solved on the histogram of lengths: at most ``capacity`` rows,
whatever the number of documents, and the only thing that comes to the driver. Reduction fixes
sets that dominate (Martello and Toth): with the largest piece in a sequence, a set dominates
another if the other's pieces can be grouped so that each group is no larger than a piece of the
set; fixing it can't cost an optimal solution a sequence. What remains is packed by best fit,
largest first. The plan gives each length ranges of sequences, and pieces take their places in them
by their rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.tasks import column, kept, slices
from gleaner.session import materialise

CAPACITY, END = 4096, 1
#: A length with more than this many pieces is ranked in parts, and the most parts of a length.
RANKED, MOST_PARTS = 256, 256
#: Words whose ids a worker keeps.
MEMO = 400_000


# Tokens


class WordEncoder:
    """Ids of texts by a byte-pair tokenizers file that never joins tokens across white space.

    Words between ASCII white space are encoded once and remembered up to a bound; words beyond it
    are encoded for each batch of texts anew. A letter before a closing mark ends a token, so a
    word and its mark are encoded apart. Words of letters only are encoded many at a time, as one
    text; the tokens that end a word tell them apart. A word with a special token in it, or
    what lower case would make one, is encoded as it is.
    """

    MARKS = frozenset(b".,;:!?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.marks = dict(zip(self.MARKS, self._each([bytes([m]) for m in self.MARKS])))

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        letters = [w for w in words if w.isalpha() or (not w.isascii() and w.decode("utf-8", "replace").isalpha())]
        out = {}
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                out.update(zip(part, [data[x:y] for x, y in zip([0, *cuts], cuts)]))
            else:  # some letter is not one for the tokenizer
                out.update(zip(part, self._each(part)))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._each(rest)))
        return out

    def _add(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't known; remembers them while there is room."""
        cores = {}
        for w in new:
            low = w.lower()
            if any(t in low for t in self.special):
                cores[w] = (w, None)
                continue
            cores[w] = (low[:-1], low[-1]) if low[-1] in self.MARKS and low[-2:-1].isalpha() else (low, None)
        known, marks = self.known, self.marks
        ids = self._ids(list({core for core, _ in cores.values()}.difference(known)))
        out = {}
        for w, (core, mark) in cores.items():
            got = ids[core] if core in ids else known[core]
            out[w] = got if mark is None else got + marks[mark]
        if len(known) < MEMO:
            known.update(ids)
            known.update(out)
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow splits the texts and numbers their distinct words, so a word is looked up once for
        all texts, and puts the words' ids in the order of the texts.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.known.get, words))
        new = self._add({w for w, x in zip(words, ids) if x is None and w})
        ids = [new.get(w, b"") if x is None else x for w, x in zip(words, ids)]  # white space at an end leaves an empty word
        placed = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(placed.buffers()[2] or b"")
        return [bytes(data[x:y]) for x, y in zip(ends[:-1], ends[1:])]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, until a stage of another kind runs in it."""

    def make() -> WordEncoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return WordEncoder(path)

    return kept(("words", path), make)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``with_ids`` adds the ids themselves as little-endian bytes."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for part in slices(batches, 1024):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[: len(rows[0])])

    wanted = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return wanted.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


# The instance


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix dominating sets for good. Returns ``(set of lengths, times)`` pairs, and the counts left.

    With the largest length ``w`` and ``rest = capacity - w``, in this order:
    nothing fits beside it; a piece of just ``rest`` dominates whatever else fits; no two pieces
    fit together, so the largest that fits dominates; no three fit together and the largest single
    piece is no smaller than the largest pair, so it dominates all singles and pairs. A length for
    which no rule holds is left for best fit; the rules go on with the next.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*members: int) -> None:
        need = {w: members.count(w) for w in members}
        times = min(left[w] // n for w, n in need.items())
        fixed.append((members, times))
        for w, n in need.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
                del sizes[bisect_left(sizes, w)]

    def fits(limit: int, without: int) -> int:
        """The largest length up to ``limit``, one piece of ``without`` put aside."""
        at = bisect_right(sizes, limit) - 1
        if at >= 0 and sizes[at] == without and left[without] < 2:
            at -= 1
        return sizes[at] if at >= 0 else 0

    def smallest(n: int, without: int) -> int | None:
        """Sum of the ``n`` smallest pieces, one piece of ``without`` put aside."""
        total, got = 0, 0
        for w in sizes[: n + 1]:
            k = min(n - got, left[w] - (w == without))
            total, got = total + k * w, got + k
            if got == n:
                return total
        return None

    def largest_pair(limit: int, without: int) -> int:
        best, lo, hi = 0, 0, bisect_right(sizes, limit) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            enough = left[a] - (a == without) >= (2 if a == b else 1) and left[b] - (b == without) >= 1
            if a + b > limit:
                hi -= 1
            elif not enough and left[b] - (b == without) < 1:
                hi -= 1
            else:
                best = max(best, a + b) if enough else best
                lo += 1
        return best

    at = len(sizes) - 1
    while at >= 0:
        at = min(at, len(sizes) - 1)
        if at < 0:
            break
        w = sizes[at]
        rest = capacity - w
        mate = fits(rest, w)
        pair, triple = smallest(2, w), smallest(3, w)
        if not mate:
            fixed.append(((w,), left.pop(w)))
            del sizes[at]
            at -= 1
        elif mate == rest or pair is None or pair > rest or ((triple is None or triple > rest) and mate >= largest_pair(rest, w)):
            take(w, mate)
            if w not in left:
                at -= 1
        else:
            at -= 1
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, largest first, on counts: ``((length, times in the sequence), ...), sequences``.

    Sequences that are filled alike are one group, so the work grows with the number of lengths.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(room: int, contents: tuple, times: int) -> None:
        if not room:
            done.append((contents, times))
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([contents, times])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                if n >= each:
                    put(capacity - each * w, ((w, each),), n // each)
                    n %= each
                else:
                    put(capacity - n * w, ((w, n),), 1)
                    n = 0
                continue
            room = rooms[at]
            each = min(room // w, n)
            contents, times = by_room[room][-1]
            use = min(times, n // each)
            if use == times:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    del rooms[at]
            else:
                by_room[room][-1][1] = times - use
            put(room - each * w, (*contents, (w, each)), use)
            n -= each * use
    return done + [(tuple(c), t) for groups in by_room.values() for c, t in groups]


RANGES = "length int, first long, upto long, each int, sequence long, at int"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of ranks: pieces ``first`` to ``upto`` of a length go ``each`` to a sequence, from
    ``sequence`` on, the first of them at offset ``at``."""
    fixed, left = reduce_by_dominance(counts, capacity)
    groups = [(tuple((w, m.count(w)) for w in dict.fromkeys(m)), times) for m, times in fixed] + best_fit(left, capacity)
    used: dict[int, int] = {}
    out, sequence = [], 0
    for contents, times in groups:
        at = 0
        for w, each in contents:
            first = used.get(w, 0)
            used[w] = first + each * times
            out.append((w, first, used[w], each, sequence, at))
            at += w * each
        sequence += times
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``). Every
    document ends with the id ``end``; null and empty texts are that id alone. Texts longer than a
    sequence are cut into full pieces and a rest. Repeated rows are packed each; null ids stay
    null. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialise(pieces(docs, tokenizer, capacity, end, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = spark.createDataFrame(plan(histogram, capacity), RANGES)
    parts = F.element_at(F.lit([min(MOST_PARTS, -(-histogram.get(k + 1, 1) // RANKED)) for k in range(capacity)]), F.col("length"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = counts.select("length", "salt", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("nth", nth).join(F.broadcast(starts), ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("before"))
    r = F.broadcast(ranges.withColumnRenamed("length", "r_length"))
    placed = ranked.join(r, (F.col("length") == F.col("r_length")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("upto")))
    nth = F.col("nth") - F.col("first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long"),
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
