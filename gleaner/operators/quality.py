"""Checks of a prepared index: each gives the rows that break a rule, and none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import digest, passage_id, safe_source
from gleaner.functions.vectors import valid
from gleaner.sources.markdown import coverage


def _gather(rules: dict[str, DataFrame]) -> DataFrame:
    """``rule, subject`` of all rules; the first column of each table is the subject."""
    out = None
    for rule, rows in rules.items():
        own = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out


def span_violations(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules of the spans (source, start, end, text, chunk_hash, passage_id) of ``sources`` (source, text).

    Identities are computed again only for paths that JSON doesn't escape, which safe ones are
    but for quotation marks.
    """
    found = spans.where("passage_id is not null")
    plain = ~F.col("source").rlike(r'["\\]')
    same = F.col("passage_id") == passage_id(F.col("source"), F.col("start"), F.col("end"), F.col("text"))
    return _gather(
        {
            "path": sources.where(~F.coalesce(safe_source(F.col("source")), F.lit(False))).select("source"),
            "source repeated": sources.groupBy("source").count().where("count > 1").select("source"),
            "spans do not tile the source": coverage(spans, sources).where("not ok").select("source"),
            "length of a span": spans.where(F.length("text") != F.col("end") - F.col("start")).select("source"),
            "blank passage": found.where(~F.col("text").rlike(r"[^\s﻿]")).select("passage_id"),
            "passage identity": found.where(plain & ~same).select("passage_id"),
            "passage repeated": found.groupBy("passage_id").count().where("count > 1").select("passage_id"),
            "chunk hash": found.where(~F.coalesce(F.col("chunk_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))).select("passage_id"),
        }
    )


def vector_violations(passages: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Rules of the vectors (chunk_hash, embedding) that ``passages`` refer to."""
    used = vectors.join(passages.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    hashed = used.select("chunk_hash", digest(F.concat_ws(",", F.col("embedding").cast("array<string>"))).alias("vector_hash"))
    return _gather(
        {
            "no vector": passages.join(vectors.select("chunk_hash"), "chunk_hash", "left_anti").select("passage_id"),
            "vector": used.where(~valid(F.col("embedding"), size)).select("chunk_hash"),
            "different vectors of an input": hashed.groupBy("chunk_hash").agg(F.countDistinct("vector_hash").alias("n")).where("n > 1").select("chunk_hash"),
        }
    )


def lexical_violations(postings: DataFrame, lengths: DataFrame, stats: DataFrame, passages: DataFrame) -> DataFrame:
    """Rules of the lexical tables: counts agree with one another, and with the passages."""
    summed = postings.groupBy("field", "id").agg(F.sum("tf").alias("sum"))
    total = lengths.groupBy("field").agg(F.sum("length").alias("sum"), F.count("*").alias("rows"))
    term = F.col("term")
    # what is told by a posting alone, and by the lengths and their sums, is looked for in one pass each
    wrong = {"term": (F.length(term) == 0) | (term != F.lower(term)), "frequency": ~F.coalesce(F.col("tf") > 0, F.lit(False))}
    rules = F.array_compact(F.array(*[F.when(holds, F.lit(rule)) for rule, holds in wrong.items()]))
    alone = postings.where(wrong["term"] | wrong["frequency"]).select(F.explode(rules).alias("rule"), term.cast("string").alias("subject"))
    both = lengths.withColumn("told", F.lit(True)).join(summed, ["field", "id"], "full")
    rule = F.when(F.col("told").isNull(), "length missing").when(F.coalesce("sum", F.lit(0)) != F.col("length"), "length")
    measured = both.select(rule.alias("rule"), F.col("id").cast("string").alias("subject")).where("rule is not null")
    return alone.unionByName(measured).unionByName(_gather(
        {
            "posting repeated": postings.groupBy("field", "term", "id").count().where("count > 1").select("term"),
            "statistics": stats.join(total, "field", "full").where(~(F.col("total_length").eqNullSafe(F.col("sum")) & F.col("n").eqNullSafe(F.col("rows")))).select("field"),
            "passage without lengths": passages.select(F.col("passage_id").alias("id")).join(lengths, "id", "left_anti"),
            "lengths without passage": lengths.select("id").distinct().join(passages.select(F.col("passage_id").alias("id")), "id", "left_anti"),
        }
    ))


def number_violations(numbered: DataFrame, passages: DataFrame) -> DataFrame:
    """Rules of the numbers (id, passage_id) of ``passages``: each has one, from 0 without gaps."""
    return _gather(
        {
            "passage without number": passages.select("passage_id").join(numbered.select("passage_id"), "passage_id", "left_anti"),
            "number without passage": numbered.select("passage_id").join(passages.select("passage_id"), "passage_id", "left_anti"),
            "passage numbered twice": numbered.groupBy("passage_id").count().where("count > 1").select("passage_id"),
            "number repeated": numbered.groupBy("id").count().where("count > 1").select("id"),
            "numbers": numbered.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> 0 or high <> n - 1").select("n"),
        }
    )


def hit_violations(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules of displayed hits (query_id, rank, source, start, end, snippet) of ``sources`` (source, text).

    A snippet without its ellipses is what the source has at its place.
    """
    joined = hits.join(sources.select("source", F.col("text").alias("body")), "source", "left")
    own = F.substring(F.col("body"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    shown = F.regexp_replace("snippet", "^…|…$", "")
    ranks = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("different"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    return _gather(
        {
            "snippet is not its span": joined.where(~F.coalesce(own.isin(F.col("snippet")) | (own == shown), F.lit(False))).select("query_id"),
            "ranks": ranks.where((F.col("n") != F.col("different")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))).select("query_id"),
        }
    )
