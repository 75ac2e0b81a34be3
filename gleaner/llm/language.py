"""Language identification with bit-sliced Bloom filters over character n-grams.

A filter is an array of cells; bit ``l`` of a cell belongs to language ``l``. The bitwise AND of the
cells that an n-gram hashes to is the set of all languages that contain it. A text's languages are
counted by bit, the count each filter would give by false positives alone is taken off, and the
language with most n-grams left is the answer.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tasks import column, mix64, release, slices, whole_row
from gleaner.session import materialise

ORDER, HASHES, BITS_PER_GRAM = 3, 3, 12
#: Texts of a language that the filters are learned from; the bound of the sample.
FIT_ROWS = 4000
#: An n-gram belongs to a language if it is no rarer there than this share of its frequency in the
#: language where it is most frequent, and occurs this often.
SHARE, LEAST = 0.25, 3
UNDETERMINED = "und"
#: Characters that are taken apart at once.
CHARS = 1 << 18

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def ngrams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n-grams, start of each text's n-grams, letters in each text)``.

    N-grams are hashes of ``order`` letters in lower case. Whatever isn't a letter is one boundary;
    a boundary can begin or end an n-gram, but is not inside it.
    """
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    stops = np.cumsum([len(t) + 1 for t in low])  # positions of the boundaries between texts
    upto = np.concatenate(([0], np.cumsum(is_letter)))
    counts = upto[stops] - upto[np.concatenate(([0], stops[:-1]))]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    place = np.cumsum(keep)
    code = np.where(is_letter, code, 0)[keep].astype(np.uint64)
    n = max(0, len(code) - order + 1)
    value = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for k in range(order):
        value = value * np.uint64(0x110003) + code[k : k + n]
        if 0 < k < order - 1:
            inside &= code[k : k + n] != 0
    if order == 1:
        inside = code[:n] != 0
    before = np.concatenate(([0], np.cumsum(inside)))
    starts = np.concatenate(([0], before[np.minimum(n, np.maximum(0, place[stops] - 1))]))
    starts[-1] = inside.sum()
    return value[inside], starts, counts


def portions(texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """``(number of its text, part of the text)`` of all texts, in lists of about ``chars`` characters.

    Long texts are cut at a space, which no n-gram spans, so their parts have just their n-grams.
    """
    owners, parts, held = [], [], 0
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = text.find(" ", at + chars)
            end = len(text) if end < 0 else end
            owners.append(k)
            parts.append(text[at:end])
            held += end - at + 1
            at = end + 1
            if held >= chars:
                yield owners, parts
                owners, parts, held = [], [], 0
            if at > len(text) or end == len(text):
                break
    if owners:
        yield owners, parts


@dataclass
class LanguageFilters:
    languages: list[str]
    cells: np.ndarray
    hashes: int
    order: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], hashes: int = HASHES, order: int = ORDER, bits_per_gram: int = BITS_PER_GRAM) -> "LanguageFilters":
        names = sorted(grams)
        if len(names) > 64:
            raise ValueError("a filter holds 64 languages at most; a FilterBank holds any number")
        most = max([len(g) for g in grams.values()] or [1])
        cells = np.zeros(1 << max(8, int(np.ceil(np.log2(max(1, most) * bits_per_gram)))), np.uint64)
        out = cls(names, cells, hashes, order)
        for l, name in enumerate(names):
            for at in out.places(grams[name]):
                cells[at] |= np.uint64(1) << np.uint64(l)
        return out

    def places(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """The cells of each n-gram, one hash after another."""
        h = mix64(values)
        step = mix64(h) | np.uint64(1)
        for k in range(self.hashes):
            yield ((h + step * np.uint64(k)) >> np.uint64(20)) & np.uint64(len(self.cells) - 1)

    def languages_of(self, values: np.ndarray) -> np.ndarray:
        """A mask for each n-gram: bit ``l`` is set if language ``l`` may contain it."""
        mask = None
        for at in self.places(values):
            mask = self.cells[at] if mask is None else mask & self.cells[at]
        return mask

    def false_positives(self) -> np.ndarray:
        """For each language the chance that its filter holds an n-gram it was never given."""
        full = [np.count_nonzero((self.cells >> np.uint64(l)) & np.uint64(1)) / len(self.cells) for l in range(len(self.languages))]
        return np.array(full) ** self.hashes

    def detect(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return FilterBank([self]).detect(texts)


@dataclass
class FilterBank:
    """Filters of 64 languages each, or of fewer in the last: one 64-bit word of every cell."""

    filters: list[LanguageFilters]

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], order: int = ORDER) -> "FilterBank":
        names = sorted(grams)
        return cls([LanguageFilters.build({l: grams[l] for l in names[at : at + 64]}, order=order) for at in range(0, len(names), 64)])

    @property
    def languages(self) -> list[str]:
        return [l for f in self.filters for l in f.languages]

    def detect(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``(language, score)`` of each text: the share of its n-grams that the language has,
        less what false positives give. Ties go to the name that sorts first. Without learned
        languages every text is ``und``."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        languages, rate = self.languages, np.concatenate([f.false_positives() for f in self.filters])
        total, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(languages)))
        for owners, parts in portions(texts):
            values, starts, in_letters = ngrams(parts, self.filters[0].order)
            np.add.at(total, owners, np.diff(starts))
            np.add.at(found, owners, in_letters)
            at = 0
            for f in self.filters:
                mask = f.languages_of(values)
                for l in range(len(f.languages)):
                    upto = np.concatenate(([0], np.cumsum((mask >> np.uint64(l)) & np.uint64(1), dtype=np.int64)))
                    np.add.at(hits[:, at], owners, upto[starts[1:]] - upto[starts[:-1]])
                    at += 1
        share = (hits / np.maximum(1, total)[:, None] - rate) / (1 - np.minimum(rate, 0.999))
        best = share.argmax(axis=1)
        score = np.clip(share[np.arange(len(texts)), best], 0.0, 1.0)
        return [(languages[b], float(s)) if n else (UNDETERMINED, 0.0) for b, s, n in zip(best, score, found)]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS, order: int = ORDER) -> FilterBank:
    """Learn the filters from at most about ``rows`` texts of each language, picked by a hash of
    the id. Rows without language, text or id are left out. N-grams are counted by Spark; the
    frequent ones of each language, bounded by the sample, come to the driver. Every 64 languages
    make a filter of their own, so their number is not limited; an empty table gives a bank without
    languages."""
    wanted = docs.select(column(lang_col).alias("lang"), column(text_col).alias("text"), column(id_col).alias("doc_id")).dropna()
    sizes = {r["lang"]: r["n"] for r in wanted.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, rows / n) * 2**32)))]) if sizes else F.create_map(F.lit(""), F.lit(0))
    sample = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            langs, texts = np.array(part.column(0).to_pylist(), object), np.array(part.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                for _, some in portions(texts[langs == lang].tolist()):
                    values, n = np.unique(ngrams(some, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = materialise(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = rates.where(F.col("n") >= LEAST).join(top, "gram").where(F.col("rate") >= SHARE * F.col("top"))
    found = chosen.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return FilterBank.build({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in found}, order=order)


def detect_languages(docs: DataFrame, filters: LanguageFilters | FilterBank, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``lang_pred``, ``score`` of every row.

    Whole texts are read. A null text, or one without a letter, is ``und`` with score 0; a text none
    of whose n-grams is known gets the language that sorts first, with score 0. Where no language
    was learned, every text is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, 256):
            names, scores = zip(*shared.value.detect(part.column(0).field(text_at).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(whole_row(docs).alias("row")).mapInArrow(run, schema)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has a letter."""
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, 256):
            good = [any(map(str.isalpha, t or "")) for t in part.column(0).field(text_at).to_pylist()]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.select(whole_row(docs).alias("row")).mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
