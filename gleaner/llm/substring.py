"""Substring deduplication: a count-min prefilter, then exact groups of what it lets through.

1. Documents are shelved: blocks of some million words, each a compressed row of a table that is
   bucketed by block. All later passes read the shelf, so texts are never shuffled.
2. Every block sketches its windows: ``DEPTH`` rows of counters. A row has ``LOAD`` cells for each
   window of the input, whatever its size, and is cut into slices of a fixed size. A block sends
   the cells that it touched, slice by slice; slices are merged by addition, which can only
   overestimate a window's count, and every block is told which of its cells reach two. A task
   holds one slice or one block at a time, and nothing is broadcast.
3. A second pass keeps the windows all of whose cells reach two. Within a block, equal windows are
   settled at once except for those of the smallest id. What is left is grouped by a 96-bit digest
   of the words in shards of that digest, and every occurrence outside the smallest id is marked.
4. Marks go back to their block by a join with the shelf, and the marked words are cut out.

A window that occurs once passes with a chance of ``(1 - exp(-1 / LOAD)) ** DEPTH``, 1.4 %, at any
size of the input. A fuller sketch would let more through, never fewer: the result is the same.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tasks import column, mix64, pack, pack_sorted, release, slices, unpack, unpack_sorted, utf8, whole_row
from gleaner.session import shared_path

WINDOW, DEPTH, LOAD, SLICE_BITS = 13, 2, 8.0, 25
#: Bytes of text in a block, and least bytes of a word, by which sketch and shards are sized.
BLOCK, WORD = 6_000_000, 5
#: Windows of the input for each shard of the exact grouping.
SHARD = 3_000_000
#: Blocks to a bucket of the shelf; Spark allows 100,000 buckets.
PER_BUCKET, MOST_BUCKETS = 1.5, 100_000
LAST = 2**63 - 1

_ODD = mix64(np.arange(1, 201, dtype=np.uint64)) | np.uint64(1)


def window_keys(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of digest of each run of ``window`` words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(window):
        a += h[k : k + n] * _ODD[k % 100]
        b += h[k : k + n] * _ODD[100 + k % 100]
        if (k + 1) % 100 == 0:  # longer windows than there are factors
            a, b = mix64(a), mix64(b)
    return mix64(a), (mix64(b) >> np.uint64(32)).astype(np.uint32)


# The shelf


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], int]]:
    """Runs of rows with at least ``size`` bytes of text, and their bytes; the third column counts bytes."""
    held, total = [], 0
    for batch in batches:
        upto = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0, np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(int(np.searchsorted(upto, before + size - total)) + 1, batch.num_rows)
            held.append(batch.slice(at, end - at).select([0, 1]))
            total += int(upto[end - 1]) - before
            at = end
            if total >= size:
                yield held, total
                held, total = [], 0
    if held:
        yield held, total


def shelve(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``(shelf, buckets, bytes of text)``: the shelf has ``block long, payload binary``, a payload
    being the rows of a block and their keys as a compressed Arrow stream."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, math.ceil(total / BLOCK / PER_BUCKET)))
    block_bytes = BLOCK
    rows = docs.select(whole_row(docs).alias("row"), F.coalesce(column(id_col).cast("long"), F.lit(LAST)).alias("key"), size.alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = TaskContext.get().partitionId() << 32
        for k, (held, _) in enumerate(_blocks(batches, block_bytes)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

    name = f"shelf_{uuid.uuid4().hex}"
    shelf = rows.mapInArrow(run, "block long, payload binary")
    shelf.write.format("parquet").bucketBy(buckets, "block").option("compression", "none").option("path", shared_path(spark, "shelf")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: files stay, and what was read from it
    return stored, buckets, total


class Block:
    """The rows of a payload: batches of rows, document keys, and texts as words on demand."""

    def __init__(self, payload: bytes, text_at: int):
        with pa.ipc.open_stream(payload) as stream:
            self.batches = list(stream)
        self.text_at = text_at

    def texts(self) -> Iterator[str | None]:
        for batch in self.batches:
            for part in slices([batch], 256):
                yield from part.column(0).field(self.text_at).to_pylist()

    def ranks(self) -> np.ndarray:
        """Ids as unsigned numbers of the same order."""
        ids = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in self.batches])
        return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests of all windows, their first words' places in the block, and where each document starts."""
        a, b, at, starts, n = [], [], [], [], 0
        for text in self.texts():
            words = utf8(text).split()
            x, y = window_keys(words, window)
            a.append(x)
            b.append(y)
            at.append(np.arange(n, n + len(x), dtype=np.uint32))
            starts.append(n)
            n += len(words)
        return np.concatenate(a), np.concatenate(b), np.concatenate(at), np.array(starts, np.int64)


# The sketch


class Sketch:
    """Sizes of a sketch for ``windows`` windows: cells to a row, slices to a row, cells to a slice."""

    def __init__(self, windows: int, load: float = LOAD, slice_bits: int = SLICE_BITS):
        self.cells = max(64, math.ceil(windows * load))
        self.slices = math.ceil(self.cells / (1 << slice_bits))
        self.per = math.ceil(self.cells / self.slices)

    def touched(self, keys: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct cells of a block's windows in a row, in order; each window's place among
        them, how often each is touched, and where each slice begins and ends."""
        cell = mix64(keys * _ODD[150 + row]) % np.uint64(self.cells)
        at, place, times = np.unique(cell, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(at, np.arange(self.slices + 1, dtype=np.uint64) * np.uint64(self.per))
        return at, place, times, cuts

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``(slice, cells)`` that a block sends. A cell that it touched twice is sent once: for
        another block either is enough to reach two, and the block itself knows."""
        for row in range(DEPTH):
            at, _, _, cuts = self.touched(keys, row)
            for k in range(self.slices):
                x, y = int(cuts[k]), int(cuts[k + 1])
                if y > x:
                    yield row * self.slices + k, pack_sorted((at[x:y] - np.uint64(k * self.per)).astype(np.uint32))

    def answer(self, parts: list[bytes]) -> list[bytes]:
        """Merge what the blocks sent for one slice; for each block a bit for every cell that it
        sent, whether its count reaches two."""
        total = np.zeros(self.per, np.uint8)
        for part in parts:
            at = unpack_sorted(part, np.uint32)
            total[at] += total[at] < 2
        return [zstandard.compress(np.packbits(total[unpack_sorted(part, np.uint32)] >= 2).tobytes(), 1) for part in parts]

    def repeated(self, keys: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """Which windows of a block the sketch estimates to occur at least twice."""
        out = np.ones(len(keys), bool)
        for row in range(DEPTH):
            at, place, times, cuts = self.touched(keys, row)
            twice = times >= 2
            for k in range(self.slices):
                x, y = int(cuts[k]), int(cuts[k + 1])
                if y > x:
                    bits = np.frombuffer(zstandard.decompress(answers[row * self.slices + k]), np.uint8)
                    twice[x:y] |= np.unpackbits(bits, count=y - x).view(bool)
            out &= twice[place]
        return out


def _answers(shelf: DataFrame, sketch: Sketch, window: int, text_at: int, buckets: int) -> DataFrame:
    """``block, answers``: for every block the bits of all slices that it touched."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(sketch.parts(Block(payload.as_py(), text_at).windows(window)[0]))
                if found:
                    k, parts = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([block] * len(k), pa.int64()), pa.array(parts, pa.binary())], ["slice", "block", "part"])

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "bits": pa.array(sketch.answer(group.column("part").to_pylist()), pa.binary())})

    sent = shelf.mapInArrow(send, "slice long, block long, part binary")
    found = sent.groupBy("slice").applyInArrow(merge, "block long, slice long, bits binary")
    return found.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("slice", "bits")).alias("answers"))


# Exact groups


def settle(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, later)``: windows sorted by digest and id, and which have a smaller id in their group.

    ``rank`` is the id of each window's document as an unsigned number.
    """
    order = np.lexsort((rank, b, a))
    a, b, low = a[order], b[order], rank[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = low[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order, low > first


def _marks(shelf: DataFrame, answers: DataFrame, sketch: Sketch, window: int, text_at: int, shards: int, buckets: int) -> DataFrame:
    """``block, parts``: packed places of the first words of the windows to remove."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                yield from one(block, Block(payload.as_py(), text_at), {x["slice"]: x["bits"] for x in told or []})

    def one(number: int, block: Block, told: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        a, b, pos, starts = block.windows(window)
        some = np.flatnonzero(sketch.repeated(a, told)) if len(a) else np.empty(0, np.int64)
        if not len(some):
            return
        a, b, pos = a[some], b[some], pos[some]
        ranks = block.ranks()
        doc = np.searchsorted(starts, pos, side="right") - 1
        order, later = settle(a, b, ranks[doc])
        rows = [(shards + number % shards, pack_sorted(np.sort(pos[order[later]])))] if later.any() else []
        left = order[~later]
        a, b, pos, doc = a[left], b[left], pos[left], doc[left]  # in the order of the digest
        cuts = np.searchsorted(a, np.array([(k << 64) // shards for k in range(shards)], np.uint64)).tolist() + [len(a)]
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                who = np.unique(doc[x:y])
                rows.append((k, _frame(pack_sorted(a[x:y]), pack(b[x:y]), pack(pos[x:y]), pack_sorted(starts[who].astype(np.uint32)), pack_sorted(ranks[who]))))
        k, parts = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([number] * len(k), pa.int64()), pa.array(parts, pa.binary())], ["shard", "block", "frame"])

    def group(part: pa.Table) -> pa.Table:
        if part.column("shard")[0].as_py() >= shards:  # settled within their block
            return pa.table({"block": part.column("block"), "part": part.column("frame")})
        frames = [_unframe(x, 5) for x in part.column("frame").to_pylist()]
        a = np.concatenate([unpack_sorted(x[0], np.uint64) for x in frames])
        b = np.concatenate([unpack(x[1], np.uint32) for x in frames])
        at = [unpack(x[2], np.uint32) for x in frames]
        rank = np.concatenate([unpack_sorted(x[4], np.uint64)[np.searchsorted(unpack_sorted(x[3], np.uint32), p, side="right") - 1] for x, p in zip(frames, at)])
        frame = np.repeat(np.arange(len(frames)), [len(p) for p in at])
        pos = np.concatenate(at)
        order, later = settle(a, b, rank)
        done = order[later]
        done = done[np.lexsort((pos[done], frame[done]))]
        cuts = np.searchsorted(frame[done], np.arange(len(frames) + 1)).tolist()
        blocks = part.column("block").to_pylist()
        rows = [(blocks[k], pack_sorted(pos[done[x:y]])) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return pa.table({"block": pa.array([k for k, _ in rows], pa.int64()), "part": pa.array([x for _, x in rows], pa.binary())})

    told = shelf.join(answers.hint("shuffle_hash"), "block", "left").select("block", "payload", "answers")
    found = told.mapInArrow(find, "shard long, block long, frame binary").groupBy("shard").applyInArrow(group, "block long, part binary")
    return found.repartition(buckets, "block").groupBy("block").agg(F.collect_list("part").alias("parts"))


def _frame(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def _unframe(data: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(data[: 4 * n], np.uint32)
    ends = np.cumsum(sizes) + 4 * n
    return [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


# Cutting


def cut(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, int, str, list[tuple[int, int]]]:
    """``(words, removed, kept words joined by one space, removed word spans)``; ``starts`` are the
    places of the first words of the windows to remove."""
    if not len(starts):
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass"), []
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    spans = list(zip(turns[::2].tolist(), turns[1::2].tolist()))
    kept = b" ".join(words[k] for k in np.flatnonzero(~gone).tolist())
    return len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, load: float = LOAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut out of every text the words of windows that a document with a smaller id has too.

    Returns ``row`` (all columns of ``docs`` as one struct, so their names can't clash),
    ``n_words, n_removed, kept_text, removed`` (spans of word positions). Windows are judged on
    the texts as given. Null and empty texts have no words; a null id ranks after all others; rows
    that share an id remove nothing from each other, whether their texts are equal or not; texts
    shorter than a window stay whole. An empty table gives no rows. ``load`` is the number of sketch
    cells for each window. The shelf stays in the shared folder.
    """
    shelf, buckets, total = shelve(docs, id_col, text_col)
    words = max(1, total // WORD)
    sketch, text_at = Sketch(words, load, SLICE_BITS), docs.columns.index(text_col)
    answers = _answers(shelf, sketch, window, text_at, buckets)
    marks = _marks(shelf, answers, sketch, window, text_at, max(1, math.ceil(words / SHARD)), buckets)
    marked = shelf.join(marks.hint("shuffle_hash"), "block", "left").select("payload", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, parts in zip(batch.column(0), batch.column(1).to_pylist()):
                places = np.sort(np.concatenate([unpack_sorted(p, np.uint32) for p in parts])).astype(np.int64) if parts else np.empty(0, np.int64)
                yield from one(Block(payload.as_py(), text_at), places)

    def one(block: Block, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0  # words before the present text
        for batch in block.batches:
            for part in slices([batch], 256):
                out = []
                for text in part.column(0).field(text_at).to_pylist():
                    words = utf8(text).split()
                    x, y = np.searchsorted(places, (at, at + len(words))).tolist()
                    out.append(cut(words, places[x:y] - at, window))
                    at += len(words)
                n, gone, kept, spans = zip(*out)
                spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["row", "n_words", "n_removed", "kept_text", "removed"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [("row", docs.schema), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("removed", spans)]
    return marked.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds]))


def cut_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the text of :func:`remove_repeats` where words were removed, else as it was.

    ``length_col``, if given, gets the new length of a changed text in characters. A document all of
    whose words go keeps its row with an empty text.
    """
    found = remove_repeats(docs, text_col=text_col, **options)
    changed = F.col("n_removed") > 0

    def value(c: str):
        was = F.col("row").getField(c)
        if c == text_col:
            return F.when(changed, F.col("kept_text")).otherwise(was).alias(c)
        if c == length_col:
            return F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return found.select(*[value(c) for c in docs.columns])
