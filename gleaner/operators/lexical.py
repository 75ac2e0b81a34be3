"""Fielded BM25: postings, lengths and statistics, and the scoring of a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import match_terms, matches, terms
from gleaner.session import bucketed, materialise

#: Fixed values of the ranker.
K1, B = 1.2, 0.75
WEIGHTS = {"body": 1.0, "headings": 2.0, "path": 2.0}
DEPTH = 40
#: Bytes of text that a task takes apart. Its counts and sums then take the same memory at any size of the input.
TEXT = 4 << 20
#: Terms of a batch of questions that are sent to the tasks, and scores that are held at once.
ASKED, HELD = 1 << 20, 1 << 21
#: Scores are rounded before they are ranked, so that the order of a sum can't change a rank.
DIGITS = 6


@dataclass
class LexicalIndex:
    """``postings`` (field, term, id, tf), ``lengths`` (field, id, length), ``stats`` (field, total_length, n).

    Postings may have ``length`` too, that of their passage's field.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    #: Every passage and field (id, field), for an index that isn't saved yet.
    every: DataFrame | None = None
    #: The postings of each field, likewise.
    fields: tuple[DataFrame, ...] = ()
    #: In how many parts passages are dealt.
    parts: int | None = None
    #: ``field, term, df``, where it was counted before.
    frequency: DataFrame | None = None

    def saved(self, path: str | None = None) -> "LexicalIndex":
        """The index with its tables written once, postings at ``path`` if it is given, so that no text is taken apart twice.

        Postings are bucketed by passage and have their lengths with them, so scores of a batch are
        summed where the postings are read: questions times passages are never shuffled.
        """
        posted = bucketed(reduce(DataFrame.unionByName, self.fields), "id", "postings", self.parts, path)
        lengths = materialise(_lengths(self.every, posted), "lengths")
        return LexicalIndex(posted, lengths, _stats(lengths), parts=self.parts)

    def terms(self) -> DataFrame:
        """``field, term, tf, df``."""
        return self.postings.groupBy("field", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def parts_for(passages: DataFrame, *texts: str) -> int:
    """Parts of about ``TEXT`` bytes in which ``texts`` are dealt; as many as shuffles have at least."""
    size = passages.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in texts), F.lit(0).cast("long")))).first()[0] or 0
    return max(int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT))


def postings(passages: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """``id, term, tf, length`` of one field; ``length`` is the number of all terms of its passage.

    Texts are dealt by the passage's key before they are taken apart: a text is smaller than its
    words with their counts, and no aggregation by passage needs an exchange after that. There are as many ``parts``
    as the texts need, whatever the session's number and the size of the packed texts are. A passage's terms are an
    array, whose size is the length, before they become rows.
    """
    dealt = passages.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition(parts or parts_for(passages, text), "id")
    whole = dealt.groupBy("id").agg(F.flatten(F.transform(F.collect_list("text"), terms)).alias("terms"))
    return whole.select("id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf")).select("id", "term", "tf", "length")


def build_index(passages: DataFrame, key: str, fields: dict[str, str]) -> LexicalIndex:
    """Index ``fields`` (field name to text column) of ``passages``, one row for each ``key``.

    A passage without terms still counts in ``n`` and has length 0.
    """
    parts = parts_for(passages, *fields.values())
    each = tuple(postings(passages, key, column, parts).select(F.lit(name).alias("field"), "term", "id", "tf", "length") for name, column in fields.items())
    posted = reduce(DataFrame.unionByName, each)
    every = passages.select(F.col(key).alias("id"), F.explode(F.array(*map(F.lit, fields))).alias("field"))
    lengths = _lengths(every, posted)
    return LexicalIndex(posted, lengths, _stats(lengths), every, each, parts)


def _lengths(every: DataFrame, posted: DataFrame) -> DataFrame:
    summed = posted.groupBy("field", "id").agg(F.sum("tf").alias("length"))
    return every.join(summed, ["field", "id"], "left").select("field", "id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def _stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.sum("length").alias("total_length"), F.count("*").alias("n"))


def field_weight(field: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), field)


def _weights(index: LexicalIndex, query_terms: DataFrame, *names: str) -> DataFrame:
    """``*names, field, idf, n, total_length`` for ``query_terms`` (with ``term`` and ``names``), written, so the planner knows their size."""
    wanted = query_terms.select("term").distinct()
    if index.frequency is not None:
        frequency = index.frequency.join(wanted, "term", "left_semi")
    else:
        frequency = index.postings.select("field", "term").join(wanted, "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    stats = index.stats.where("total_length > 0")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = frequency.join(F.broadcast(stats), "field").join(query_terms, "term")
    return materialise(known.select(*names, "field", "term", idf.alias("idf"), "n", "total_length"), "weights")


def _parts(index: LexicalIndex, weights: DataFrame, *names: str) -> DataFrame:
    """``*names, id, part``: what each posting of a weighted term adds to a score."""
    hits = index.postings.join(weights, ["field", "term"])
    measured = hits if "length" in hits.columns else hits.join(index.lengths, ["field", "id"])
    share = F.col("length") * F.col("n") / F.col("total_length")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * share)) * field_weight(F.col("field"))
    return measured.select(*names, "id", part.alias("part"))


def bm25(index: LexicalIndex, query_terms: DataFrame) -> DataFrame:
    """``query_id, id, score`` for ``query_terms`` (query_id, term), each term once for a query.

    Document frequencies are counted from postings of query terms alone, unless they were before. The weights of a batch's terms,
    a row for each term, field and question, are written before they are joined, so the planner knows
    their size and sends them to the postings where they are small.
    """
    parts = _parts(index, _weights(index, query_terms, "query_id"), "query_id")
    return parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))


def bm25_top(index: LexicalIndex, query_terms: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of ``top(bm25(index, query_terms), depth)``, for a batch of questions.

    What a posting adds is the same for all questions that have its term, so it is a row once, not once for each
    question. The postings of a passage are brought together where they are read, and a task sums them up for all questions in a
    matrix of some passages and keeps the best of each question. Which questions have a term is sent to
    the tasks; a batch of more than ``ASKED`` terms is scored by joins.
    """
    spark = query_terms.sparkSession
    asked = query_terms.limit(ASKED + 1).toArrow()
    if asked.num_rows > ASKED:
        return top(bm25(index, query_terms), depth)
    term, number = np.unique(asked.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if asked.num_rows else (np.empty(0, object), np.empty(0, np.int64))
    ids, place = np.unique(asked.column("query_id").to_numpy().astype(np.int64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    place, many = place[order], np.bincount(number, minlength=len(term))
    begins = np.cumsum(many) - many
    numbered = spark.createDataFrame(pa.table({"term": pa.array(term.tolist(), pa.string()), "no": pa.array(np.arange(len(term)), pa.int32())}))

    def sums(rows: np.ndarray, no: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` passages by all questions, from postings (their passage, term and part) in the order of passages."""
        out = np.zeros((n, len(ids)))
        cuts = np.searchsorted(np.cumsum(many[no]), np.arange(HELD, many[no].sum() + HELD, HELD)).tolist()
        for x, y in zip([0, *cuts], [*cuts, len(no)]):
            times = many[no[x:y]]
            each = np.repeat(np.arange(x, y), times)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            at = rows[each] * len(ids) + place[begins[no[each]] + nth]
            if len(at):
                low, high = int(rows[x]), int(rows[y - 1]) + 1  # a passage may go on in the next run
                out[low:high] += np.bincount(at - low * len(ids), part[each], (high - low) * len(ids)).reshape(high - low, -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held = max(1, HELD // max(1, len(ids))), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                key, lists = some.column(0).to_numpy(), some.column(1)
                flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                raw = sums(np.repeat(np.arange(len(key)), sizes), flat.field("no").to_numpy(), flat.field("part").to_numpy(), len(key))
                score = np.round(raw, DIGITS)
                if len(key) > depth:
                    least = np.partition(score, len(key) - depth, axis=0)[len(key) - depth]
                    q, d = np.nonzero(((score >= least) & (raw > 0)).T)
                else:
                    q, d = np.nonzero(raw.T > 0)
                held.append(_best(*map(np.concatenate, zip(held.pop(), (q, key[d], score[d, q]))), depth))
        q, key, score = held[0]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(key), pa.array(score)], ["query_id", "id", "score"])

    parts = _parts(index, _weights(index, numbered, "no"), "no")
    whole = parts.groupBy("id").agg(F.collect_list(F.struct("no", "part")).alias("parts"))
    return top(whole.select(F.col("id").cast("long").alias("id"), "parts").mapInArrow(run, "query_id long, id long, score double"), depth)


def _best(q: np.ndarray, key: np.ndarray, score: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``depth`` best of each question, ties by key."""
    order = np.lexsort((key, -score, q))
    q, key, score = q[order], key[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < depth
    return q[kept], key[kept], score[kept]


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``query_id, term`` of each query, every term once."""
    found = queries.select(F.col(key).alias("query_id"), F.explode(matches(F.col(text))).alias("match"))
    return found.select("query_id", F.explode(match_terms(F.col("match"))).alias("term")).distinct()


def top(scores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``query_id, rank, id, score``: the best of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth).select("query_id", "rank", "id", "score")
