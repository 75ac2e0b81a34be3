"""Weighted reciprocal-rank fusion with protected results and a soft cap for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the fusion.
K, ORIGINAL, VARIANT, PROTECTED, SOURCE_CAP, DEPTH = 60, 2.0, 1.0, 8, 2, 40
DIGITS = 9


def fuse(lists: DataFrame, depth: int = DEPTH, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``*by, id, score, protected``: the fused score of each candidate.

    ``lists``: ``query_id, channel, is_original, id, rank``. A candidate counts once in a channel, at
    its best rank; ranks beyond ``depth`` don't count. The first eight of an original list are protected.
    """
    once = lists.groupBy(*by, "channel", "is_original", "id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy(*by, "channel").orderBy("rank", "id")
    ranked = once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth)
    part = F.when(F.col("is_original"), ORIGINAL).otherwise(VARIANT) / (K + F.col("rank"))
    safe = F.col("is_original") & (F.col("rank") <= PROTECTED)
    return ranked.groupBy(*by, "id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.max(safe).alias("protected"))


def fuse_views(lists: DataFrame, views: dict[str, Column], depth: int = DEPTH) -> DataFrame:
    """``view, query_id, rank, id, score, protected``: every view of the lists fused in one pass.

    A view is a condition on rows of ``lists``; each row goes to all views that it belongs to, and what
    all views share is read once.
    """
    names = F.array(*[F.when(test, F.lit(name)) for name, test in views.items()])
    each = lists.withColumn("view", F.explode(F.filter(names, lambda x: x.isNotNull())))
    fused = fuse(each, depth, ("view", "query_id"))
    order = Window.partitionBy("view", "query_id").orderBy(F.col("score").desc(), "id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth)
    return ranked.select("view", "query_id", "rank", "id", "score", "protected")


def protect(fused: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``query_id, id, source, score, class, fused_rank`` of the ``depth`` that stay.

    ``fused``: the result of :func:`fuse` with the ``source`` of each id. Protected candidates (class
    0) come first, then those within the cap of their source (1), then the rest (2), each by
    score; those that stay are returned in the order of their scores.
    """
    best = [F.col("score").desc(), F.col("source"), F.col("id")]
    by_source = Window.partitionBy("query_id", "source")
    ranked = fused.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    ranked = ranked.withColumn("safe", F.sum(F.col("protected").cast("int")).over(by_source))
    nth = F.row_number().over(Window.partitionBy("query_id", "source", "protected").orderBy("order"))
    kind = F.when(F.col("protected"), 0).when(F.col("safe") + nth <= SOURCE_CAP, 1).otherwise(2)
    ranked = ranked.withColumn("class", kind)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("class", "order"))
    kept = ranked.withColumn("place", place).where(F.col("place") <= depth)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("order")).cast("long")
    return kept.select("query_id", "id", "source", "score", "class", again.alias("fused_rank"))


def rerank_cutoff(scored: DataFrame, least: float = 0.435546875, best: int = 8) -> DataFrame:
    """``query_id, rank, id, relevance, score``: the first ``best`` whose relevance reaches ``least``.

    ``scored``: ``query_id, id, index, relevance``; ties go to the smaller index. ``score`` is the reciprocal of the rank.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "index")
    ranked = scored.where(F.col("relevance") >= least).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= best).select("query_id", "rank", "id", "relevance", F.round(1 / F.col("rank"), 6).alias("score"))
