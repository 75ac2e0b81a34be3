"""Exact cosine search of a batch of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6
#: Bytes of vectors in a block, as 32-bit floats, and queries in a block at most.
BLOCK, QUERY_BLOCK = 8 << 20, 512
#: Scores of a product that are held at once.
SCORES = 1 << 21


def _blocks(vectors: DataFrame, name: str, most: int) -> DataFrame:
    """Vectors packed into blocks of about ``BLOCK`` bytes, dealt by a hash of the id: one row a block."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("long")).first()
    each = max(1, min(most, BLOCK // (4 * max(1, size["long"] or 1))))
    blocks = max(1, -(-size["n"] // each))
    dealt = vectors.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "v")).alias(name)).drop("_block")


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """``rows``: blocks of ``vectors`` (id, v), to be written once and searched often."""
    return _blocks(vectors, "rows", 1 << 30)


def _unpack(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    found = rows.values
    ids = found.field("id").to_numpy(zero_copy_only=False)
    flat = found.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    unit = flat.reshape(len(ids), -1)
    return ids, unit / np.linalg.norm(unit, axis=1, keepdims=True)


def cosine_top(queries: DataFrame, vectors: DataFrame, depth: int, itself: bool = True) -> DataFrame:
    """``query_id, rank, id, score``: for each of ``queries`` (id, v) the ``depth`` nearest ``vectors`` (id, v).

    Every pair of a query block and a vector block is one matrix product, which keeps the best of
    each query; these are merged by a window. No score but those leaves its task. Null vectors and
    ids must be filtered before. Ties go to the smaller id. ``itself``: whether a query can find
    its own id. ``vectors`` may be the blocks of :func:`pack_vectors` instead.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q_ids, q = _unpack(batch.column("queries")[k])
                ids, rows = _unpack(batch.column("rows")[k])
                step = max(1, SCORES // len(ids))
                for at in range(0, len(q_ids), step):
                    yield some(q_ids[at : at + step], q[at : at + step], ids, rows)

    def some(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        score = np.round(q @ rows.T, DIGITS) + 0.0
        if not itself:
            score[q_ids[:, None] == ids[None, :]] = -2.0
        last = max(0, len(ids) - depth)
        least = np.partition(score, last, axis=1)[:, last]
        i, j = np.nonzero((score >= least[:, None]) & (score > -2.0))  # with all ties of the last, which go by id
        order = np.lexsort((ids[j], -score[i, j], i))
        i, j = i[order], j[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < depth
        i, j = i[kept], j[kept]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i], ids[j], score[i, j])], ["query_id", "id", "score"])

    left, right = _blocks(queries, "queries", QUERY_BLOCK), vectors if vectors.columns == ["rows"] else pack_vectors(vectors)
    pairs = right.crossJoin(left)
    found = pairs.mapInArrow(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth).select("query_id", "rank", "id", "score")


def cosine_above(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``query_id, id, cosine`` of all pairs of ``queries`` and ``vectors`` (id, v) whose cosine is ``least`` or more.

    Blocks are compared as by :func:`cosine_top`; only pairs that reach the bound leave their task.
    """

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q_ids, q = _unpack(batch.column("queries")[k])
                ids, rows = _unpack(batch.column("rows")[k])
                score = q @ rows.T
                i, j = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i], ids[j], score[i, j])], ["query_id", "id", "cosine"])

    return pack_vectors(vectors).crossJoin(_blocks(queries, "queries", QUERY_BLOCK)).mapInArrow(reaching, "query_id long, id long, cosine double")
