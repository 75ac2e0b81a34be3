"""The earlier ranker, kept as a baseline: weighted coverage of the query's tokens and cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import baseline_normalised, baseline_tokens
from gleaner.operators.patterns import places
from gleaner.operators.similarity import cosine_above
from gleaner.session import materialise

#: The parts of the score, and the score that a result must have.
COSINE, BODY, HEADING, PATH, PHRASE, LEAST = 0.8, 0.06, 0.03, 0.01, 0.1, 0.25


def rank_baseline(candidates: DataFrame, best: int = 8) -> DataFrame:
    """``query_id, rank, id, source, score`` for ``candidates`` (query_id, query, id, source, heading, text, cosine).

    One result for each source, its best; ties by source, then id.
    """
    query = baseline_tokens(F.col("query"))

    def covered(column: str):
        share = F.size(F.array_intersect(query, baseline_tokens(F.col(column)))) / F.size(query)
        return F.when(F.size(query) == 0, 0.0).otherwise(share)

    phrase = baseline_normalised(F.col("query"))
    whole = F.when((F.length(phrase) > 0) & baseline_normalised(F.col("text")).contains(phrase), PHRASE).otherwise(0.0)
    score = COSINE * F.col("cosine") + BODY * covered("text") + HEADING * covered("heading") + PATH * covered("source") + whole
    scored = candidates.withColumn("score", F.round(score, 6)).where(F.col("score") >= LEAST)
    return _best(scored, best)


def _best(scored: DataFrame, best: int) -> DataFrame:
    """The best of each source, then of these."""
    own = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "id")
    first = scored.withColumn("n", F.row_number().over(own)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "id")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best).select("query_id", "rank", "id", "source", "score")


def rank_baseline_batch(asked: DataFrame, vectors: DataFrame, docs: DataFrame, best: int = 8) -> DataFrame:
    """As :func:`rank_baseline`, for all pairs of ``asked`` (query_id, query, v) and ``docs`` (id, source, heading, text) with ``vectors`` (id, v).

    Tokens are made once a query and document. Which texts contain a query is found in one scan for all queries.
    All but the cosine adds up to little, so a pair must have a certain cosine, found in blocks, to
    reach ``LEAST``: token lists are joined for such pairs only, and texts for none.
    """
    tokens = lambda c: baseline_tokens(F.coalesce(F.col(c), F.lit("")))
    known = materialise(docs.select("id", "source", *[tokens(c).alias(f"{c}_tokens") for c in ("text", "heading", "source")]), "tokens")
    words = materialise(asked.select("query_id", tokens("query").alias("words"), baseline_normalised(F.col("query")).alias("phrase")), "words")
    whole = places(words.select(F.col("phrase").alias("pattern")), docs.select("id", baseline_normalised(F.col("text")).alias("text")))
    whole = whole.select(F.col("pattern").alias("phrase"), "id", F.lit(PHRASE).alias("whole")).distinct()
    rest = BODY + HEADING + PATH
    near = cosine_above(asked.select(F.col("query_id").alias("id"), "v"), vectors, (LEAST - rest - PHRASE) / COSINE - 1e-5)
    flagged = near.join(words.select("query_id", "phrase"), "query_id").join(whole, ["phrase", "id"], "left").withColumn("whole", F.coalesce("whole", F.lit(0.0))).drop("phrase")
    close = materialise(flagged.where(COSINE * F.col("cosine") + rest + F.col("whole") >= LEAST - 1e-5), "close")

    def covered(column: str):
        share = F.size(F.array_intersect("words", f"{column}_tokens")) / F.size("words")
        return F.when(F.size("words") == 0, 0.0).otherwise(share)

    score = COSINE * F.col("cosine") + BODY * covered("text") + HEADING * covered("heading") + PATH * covered("source") + F.col("whole")
    pairs = close.join(words.select("query_id", "words"), "query_id").join(known, "id")
    return _best(pairs.select("query_id", "id", "source", F.round(score, 6).alias("score")).where(F.col("score") >= LEAST), best)
