"""Phrase collocations: a merged count-min sketch, exact counts of what it lets through, scores.

1. Texts are shelved in blocks, each a compressed row of a table that is bucketed by block. Both
   passes read the shelf, so texts are never shuffled.
2. Every block sketches its n-grams: ``DEPTH`` rows of counters, of which there are one for some
   ``LOAD`` n-grams of the input, whatever its size. A block sends the cells that it touched and their
   counts, slice by slice; slices are merged by addition. A cell's sum is at least the count of each
   n-gram in it. Sums and what is sent stop at the wanted count, which changes no decision.
   Every block is told which of its cells reach it. That is done twice: first for words and pairs, then for
   longer n-grams of which all pairs have passed, since no others can be frequent.
3. A second pass counts exactly those n-grams all of whose cells do, by their words, within each
   block and then, from sorted and compressed lists, in shards. What is counted at least as often as wanted is all that is: an
   n-gram is never below its estimate's bound, and the parts of a frequent n-gram are as frequent.
4. Frequent phrases are scored by joins with their parts, and go if a longer one has them.
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
from pyspark.sql.window import Window

from gleaner.llm.tasks import column, mix64, pack, pack_sorted, unpack, unpack_sorted, utf8
from gleaner.session import materialise, shared_path

LONGEST, WANTED, COVER, BEST = 4, 30, 80, 2000
DEPTH, LOAD = 2, 16
#: Places of the input for each at which all pairs of a longer n-gram pass, by which its sketch is sized.
RARER = 4
#: Bytes of text in a block; and bytes of a word, by which the sketch is sized.
BLOCK, WORD = 10_000_000, 6
#: Cells of a slice: the least, and the most, which a task holds as bytes; between them slices are so
#: many that a block sends ``FRAMES`` frames a row.
LEAST_BITS, MOST_BITS, FRAMES = 21, 26, 1024
#: Blocks to a bucket of the shelf; Spark allows 100,000 buckets.
PER_BUCKET, MOST_BUCKETS = 1.5, 100_000
#: Words of the input for each shard of the exact counts; a shard has a thirtieth of its n-grams at most.
SHARD = 20_000_000
#: Bytes of a text that are words at once.
PORTION = 1 << 20

_ODD = mix64(np.arange(1, 32, dtype=np.uint64)) | np.uint64(1)
#: Ends of pieces become a byte that UTF-8 never has, and word breaks a space.
_END = b"\xff"
_TABLE = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + _END * 10)


def portions(text: bytes) -> Iterator[bytes]:
    """A translated text in parts that end where a word or a piece does."""
    at = 0
    while len(text) - at > PORTION:
        cut = max(text.rfind(b" ", at, at + PORTION), text.rfind(_END, at, at + PORTION)) + 1
        if not cut:  # a word longer than a portion
            ends = [x for x in (text.find(b" ", at + PORTION), text.find(_END, at + PORTION)) if x >= 0]
            cut = min(ends) + 1 if ends else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


class Words:
    """The words of texts of one language as numbers; 0 is the end of a piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {_END: 0}
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        numbers = self.numbers
        for part in portions(utf8(text).lower().translate(_TABLE)):
            tokens = part.replace(_END, b" \xff ").split()
            for w in set(tokens).difference(numbers):
                numbers[w] = len(numbers)
            self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
        self.parts.append(np.zeros(1, np.uint32))

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))


def ngrams(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(n, places)`` of all n-grams that lie within a piece."""
    inside = whole = ids != 0
    for n in range(1, longest + 1):
        if n > 1:
            inside = inside[:-1] & whole[n - 1 :]
        if not len(inside):
            return
        yield n, np.flatnonzero(inside)


def over_pairs(size: int, pairs: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(n, places)`` of the n-grams of three words or more all of whose pairs are among the places ``pairs``."""
    whole = np.zeros(size, bool)
    whole[pairs] = True
    inside = whole
    for n in range(3, longest + 1):
        inside = inside[:-1] & whole[n - 2 :]
        if not len(inside):
            return
        yield n, np.flatnonzero(inside)


def keys(hashes: np.ndarray, n: int, places: np.ndarray, lang: str) -> np.ndarray:
    """64 bits of digest of the n-grams at ``places``; ``hashes`` is that of each word in turn."""
    out = np.full(len(places), xxhash.xxh3_64_intdigest(utf8(lang)), np.uint64) * _ODD[n]
    for k in range(n):
        out += hashes[places + k] * _ODD[8 + k]
    return mix64(out)


def by_language(payload: bytes) -> Iterator[tuple[str, Words]]:
    """The words of a block by language."""
    with pa.ipc.open_stream(payload) as stream:
        table = stream.read_all()
    langs = table.column("lang").to_pylist()
    rows: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        rows.setdefault(lang, []).append(k)
    texts = table.column("text")
    for lang, own in rows.items():
        words = Words()
        for k in own:
            words.add(texts[k].as_py() or "")
        yield lang, words


# The shelf


def shelve(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``(shelf, buckets, bytes of text)``: the shelf has ``block long, payload binary``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, math.ceil(total / BLOCK / PER_BUCKET)))

    def stored(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            upto = np.cumsum([x.nbytes for x in (batch.column(1).slice(k, 1) for k in range(batch.num_rows))])
            at = 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                end = min(int(np.searchsorted(upto, before + BLOCK - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(upto[end - 1]) - before
                at = end
                if size >= BLOCK:
                    yield stored(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield stored(number, held)

    name = f"shelf_{uuid.uuid4().hex}"
    rows.mapInArrow(run, "block long, payload binary").write.format("parquet").bucketBy(buckets, "block").option("compression", "none").option("path", shared_path(spark, "shelf")).saveAsTable(name)
    shelf = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: files stay, and what was read from it
    return shelf, buckets, total


# The sketch


class Sketch:
    """Sizes of a sketch for so many n-grams: cells of a row, which lie in slices of ``2 ** slice_bits``."""

    def __init__(self, ngrams: int, wanted: int, load: float = LOAD, least_bits: int = LEAST_BITS):
        self.wanted = wanted
        self.size = max(64, math.ceil(ngrams / load))
        self.slice_bits = max(least_bits, min(MOST_BITS, math.ceil(math.log2(self.size / FRAMES))))
        self.slices = math.ceil(self.size / (1 << self.slice_bits))

    def cells(self, found: np.ndarray, row: int) -> np.ndarray:
        return mix64(found * _ODD[16 + row]) % np.uint64(self.size)

    def parts(self, cells: np.ndarray, row: int) -> Iterator[tuple[int, bytes]]:
        """``(slice, cells and counts)`` of a block's n-grams; ``cells`` is sorted in place."""
        cells.sort()
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        at = cells[first]
        times = np.minimum(np.diff(np.append(first, len(cells))), self.wanted).astype(np.uint32)
        cuts = np.searchsorted(at, np.arange(self.slices + 1, dtype=np.uint64) << np.uint64(self.slice_bits)).tolist()
        for k in range(self.slices):
            x, y = cuts[k], cuts[k + 1]
            if y > x:
                inner = (at[x:y] & np.uint64((1 << self.slice_bits) - 1)).astype(np.uint32)
                yield row * self.slices + k, _joined(pack_sorted(inner), pack(times[x:y]))

    def answer(self, parts: list[bytes]) -> list[bytes | None]:
        """Merge what blocks sent for a slice; for each, those of its cells that reach the wanted count."""
        total = np.zeros(1 << self.slice_bits, np.uint32 if self.wanted > 127 else np.uint8)
        for part in parts:
            at, times = _parted(part)
            at = unpack_sorted(at, np.uint32)
            total[at] = np.minimum(total[at] + unpack(times, np.uint32), self.wanted)
        full, out = total >= self.wanted, []
        for part in parts:
            at = unpack_sorted(_parted(part)[0], np.uint32)
            at = at[full[at]]
            out.append(pack_sorted(at) if len(at) else None)
        return out


class Full:
    """The cells that reach the wanted count, of those that a block sent."""

    def __init__(self, sketch: Sketch, told: list[dict]):
        self.sketch, self.rows = sketch, []
        for row in range(DEPTH):
            own = sorted((x["slice"] - row * sketch.slices, x["full"]) for x in told if x["slice"] // sketch.slices == row)
            cells = [unpack_sorted(full, np.uint32).astype(np.uint64) + np.uint64(k << sketch.slice_bits) for k, full in own]
            cells = np.concatenate(cells) if cells else np.empty(0, np.uint64)
            rough = np.zeros(1 << 22, bool)  # most n-grams are told by it alone
            rough[(cells & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.rows.append((cells, rough))

    def passing(self, found: np.ndarray) -> np.ndarray:
        """Which keys are in full cells only, as places."""
        left = np.arange(len(found))
        for row, (cells, rough) in enumerate(self.rows):
            own = self.sketch.cells(found[left], row)
            some = rough[(own & np.uint64((1 << 22) - 1)).astype(np.int64)]
            left, own = left[some], own[some]
            if not len(cells):
                return left[:0]
            left = left[cells[np.minimum(np.searchsorted(cells, own), len(cells) - 1)] == own]
        return left


def _joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _parted(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def _full_cells(shelf: DataFrame, sketch: Sketch, longest: int, buckets: int, pairs: Sketch | None = None) -> DataFrame:
    """``block, told``: for every block those of its cells that reach the wanted count.

    Words and pairs are sketched, or, where ``pairs`` is the sketch of these and ``shelf`` has what it
    ``told``, n-grams of three words or more.
    """

    def sketched(lang: str, words: Words, full: Full | None) -> list[np.ndarray]:
        ids = words.ids()
        hashes, own = words.hashes()[ids], ngrams(ids, min(2, longest))
        if full:
            two = [places for n, places in own if n == 2]
            two = two[0][full.passing(keys(hashes, 2, two[0], lang))] if two else np.empty(0, np.int64)
            own = over_pairs(len(ids), two, longest)
        return [keys(hashes, n, places, lang) for n, places in own]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if pairs else [None] * batch.num_rows):
                full, found = Full(pairs, cells or []) if pairs else None, []
                for lang, words in by_language(payload.as_py()):
                    found += sketched(lang, words, full)
                found = np.concatenate(found) if found else np.empty(0, np.uint64)
                for row in range(DEPTH if len(found) else 0):
                    k, parts = zip(*sketch.parts(sketch.cells(found, row), row))
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([block] * len(k), pa.int64()), pa.array(parts, pa.binary())], ["slice", "block", "part"])

    def merge(group: pa.Table) -> pa.Table:
        out = sketch.answer(group.column("part").to_pylist())
        return pa.table({"block": group.column("block"), "slice": group.column("slice"), "full": pa.array(out, pa.binary())})

    sent = shelf.mapInArrow(send, "slice long, block long, part binary")
    found = sent.groupBy("slice").applyInArrow(merge, "block long, slice long, full binary").where("full is not null")
    return found.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("slice", "full")).alias("told"))


# Exact counts


def distinct(ids: np.ndarray, n: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different n-gram among ``places``, compared word by word, and how often it is there."""
    cols = [ids[places + k] for k in range(n)]
    order = np.lexsort(cols)
    new = np.zeros(len(places), bool)
    new[:1] = True
    for c in cols:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return places[order[first]], np.diff(np.append(first, len(places)))


def frequent_phrases(docs: DataFrame, wanted: int = WANTED, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", load: float = LOAD, least_bits: int = LEAST_BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n_words, a)`` of all phrases of at most ``longest`` words that occur ``wanted`` times
    at least in their language, and ``(lang, n)``, the words of each language; both stored.

    Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, and these into words at spaces
    and tabs; phrases don't reach over pieces.
    """
    shelf, buckets, total = shelve(docs, lang_col, text_col)
    words = max(1, total // WORD)
    shards = max(1, math.ceil(words / SHARD))
    short, long = Sketch(words * min(2, longest), wanted, load, least_bits), Sketch(words * max(1, longest - 2) // RARER, wanted, load, least_bits)

    def join(left: DataFrame, cells: DataFrame, name: str) -> DataFrame:
        return left.join(cells.withColumnRenamed("told", name).hint("shuffle_hash"), "block", "left")

    told = join(shelf, materialise(_full_cells(shelf, short, longest, buckets), "told"), "short")
    if longest > 2:
        told = join(told, materialise(_full_cells(told.select("block", "payload", "short"), long, longest, buckets, short), "told"), "long")
    else:
        told = told.withColumn("long", F.lit(None).cast("array<struct<slice:bigint,full:binary>>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, *cells in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                full = [Full(sketch, x or []) for sketch, x in zip((short, long), cells)]
                for lang, own in by_language(payload.as_py()):
                    yield from one(lang, own, *full)

    def passing(ids: np.ndarray, hashes: np.ndarray, lang: str, short: Full, long: Full) -> Iterator[tuple[int, np.ndarray]]:
        two = np.empty(0, np.int64)
        for n, places in ngrams(ids, min(2, longest)):
            two = places[short.passing(keys(hashes, n, places, lang))]
            yield n, two
        for n, places in over_pairs(len(ids), two, longest) if longest > 2 else ():
            yield n, places[long.passing(keys(hashes, n, places, lang))]

    def one(lang: str, words: Words, short: Full, long: Full) -> Iterator[pa.RecordBatch]:
        ids = words.ids()
        names, hashes = list(words.numbers), words.hashes()[ids]
        phrases, times = [b""], [np.array([np.count_nonzero(ids)])]  # no phrase stands for all words
        for n, places in passing(ids, hashes, lang, short, long):
            at, often = distinct(ids, n, places)
            times.append(often)
            for x in range(0, len(at), 20_000):
                phrases += [b" ".join([names[k] for k in p]) for p in ids[at[x : x + 20_000, None] + np.arange(n)].tolist()]
        times = np.concatenate(times).astype(np.uint64)
        shard = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases)) % np.uint64(shards)
        for k in np.unique(shard).tolist():
            own = sorted(np.flatnonzero(shard == k).tolist(), key=phrases.__getitem__)
            frame = _joined(zstandard.compress(b"\n".join([phrases[x] for x in own]), 3), pack(times[own]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([lang], pa.string()), pa.array([frame], pa.binary())], ["shard", "lang", "frame"])

    def total_up(group: pa.Table) -> pa.Table:
        sums: dict[str, dict[bytes, int]] = {}
        for lang, frame in zip(group.column("lang").to_pylist(), group.column("frame")):
            own, (names, times) = sums.setdefault(lang, {}), _parted(frame.as_py())
            for phrase, n in zip(zstandard.decompress(names).split(b"\n"), unpack(times, np.uint64).tolist()):
                own[phrase] = own.get(phrase, 0) + n
        rows = [(lang, p, n) for lang, own in sums.items() for p, n in own.items() if n >= wanted or not p]
        langs, phrases, n = zip(*rows) if rows else ((), (), ())
        words = [p.count(b" ") + 1 if p else 0 for p in phrases]
        phrases = [p.decode("utf-8", "surrogatepass") for p in phrases]
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "n_words": pa.array(words, pa.int32()), "a": pa.array(n, pa.int64())})

    counted = told.select("payload", "short", "long").mapInArrow(count, "shard long, lang string, frame binary").groupBy("shard").applyInArrow(total_up, "lang string, phrase string, n_words int, a long")
    stored = materialise(counted, "phrases")
    return stored.where("n_words > 0"), stored.where("n_words = 0").select("lang", F.col("a").alias("n"))


# Scores


def score(phrases: DataFrame) -> DataFrame:
    """Candidates, phrases of two words or more, with ``l, r, score`` of their lowest cut."""
    words = F.split("phrase", " ")
    cuts = phrases.where("n_words > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("right"))
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # a division of decimals would round; whole numbers of 38 digits divide exactly
    value = F.expr("cast(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div cast(l + r as decimal(18,0)) as long)")
    cuts = cuts.withColumn("score", value)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "n_words", "a").agg(lowest).select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def subsumed(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """``lang, phrase`` of those that a longer phrase contains which occurs ``cover`` % as often at least."""
    words, n = F.split("phrase", " "), F.col("n_words")
    shorter = phrases.where("n_words > 2").select("lang", "n_words", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), n - 1)).alias("m"))
    inner = shorter.select("lang", F.col("a").alias("longer"), "w", "m", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)).alias("at"))
    most = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = phrases.where("n_words > 1").join(most, ["lang", "phrase"])
    return found.where(100 * F.col("longer").cast("decimal(20,0)") >= cover * F.col("a").cast("decimal(20,0)")).select("lang", "phrase")


def mine(docs: DataFrame, wanted: int = WANTED, longest: int = LONGEST, cover: int = COVER, best: int = BEST, lang_col: str = "lang", text_col: str = "text", load: float = LOAD, least_bits: int = LEAST_BITS) -> DataFrame:
    """The ``best`` collocations of each language.

    Returns ``lang, rank, phrase, a, l, r, n, score``. Null and empty texts have no words, null
    languages are ``und``, as documents are that say so. Repeated rows count each; ids are not read, and
    other columns neither, whatever their names. Words and texts may be of any length. An empty table
    gives no rows. ``load`` and ``least_bits`` size the sketch and don't change the result.
    """
    phrases, totals = frequent_phrases(docs, wanted, longest, lang_col, text_col, load, least_bits)
    kept = score(phrases).join(subsumed(phrases, cover), ["lang", "phrase"], "left_anti")
    # the best of each share of a language's phrases, then of these: no task ranks a whole language
    shares = max(1, math.isqrt(phrases.count() // best))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares)).alias("share")
    first = kept.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
