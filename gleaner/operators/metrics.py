"""Graded retrieval metrics: novelty of evidence, units and credits, summaries, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.numbering import numbered

#: Gain of each grade, and the depth of the metrics.
DEPTH = 8


def gain(grade: Column) -> Column:
    return F.when(grade >= 2, 3.0).when(grade == 1, 1.0).otherwise(0.0)


def _discounted(value: Column, rank: Column) -> Column:
    return value / F.log2(rank + 1)


def score_evidence(hits: DataFrame, evidence: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Metrics of each query: ``query_id, useful1, useful3, useful5, useful8, ndcg8, span_recall8, nonempty``.

    ``hits``: ``query_id, rank, evidence_id``, the evidence that the result at a rank covers.
    ``evidence``: ``query_id, evidence_id, grade``. Evidence counts at the first rank that covers it.
    A query without positive evidence is unanswerable and has null metrics, which is not zero.
    """
    top = hits.where(F.col("rank") <= depth)
    first = top.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("rank")).join(evidence, ["query_id", "evidence_id"])
    by_rank = first.groupBy("query_id", "rank").agg(F.max("grade").alias("grade"), F.sum((F.col("grade") > 0).cast("int")).alias("spans"))
    useful = [F.max(((F.col("grade") >= 2) & (F.col("rank") <= k)).cast("int")).alias(f"useful{k}") for k in (1, 3, 5, 8)]
    got = by_rank.groupBy("query_id").agg(*useful, F.sum(_discounted(gain(F.col("grade")), F.col("rank"))).alias("dcg"), F.sum("spans").alias("spans"))
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "evidence_id")
    ranked = evidence.where("grade > 0").withColumn("rank", F.row_number().over(order).cast("long"))
    ideal = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= depth, _discounted(gain(F.col("grade")), F.col("rank")))).alias("ideal"), F.count("*").alias("total"))
    queries = evidence.select("query_id").distinct()
    shown = top.select("query_id").distinct().withColumn("nonempty", F.lit(1))
    joined = queries.join(ideal, "query_id", "left").join(got, "query_id", "left").join(shown, "query_id", "left")
    answerable = F.col("total") > 0

    def known(c: Column) -> Column:
        return F.when(answerable, c)

    return joined.select(
        "query_id",
        *[known(F.coalesce(f"useful{k}", F.lit(0))).alias(f"useful{k}") for k in (1, 3, 5, 8)],
        known(F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6)).alias("ndcg8"),
        known(F.round(F.coalesce("spans", F.lit(0)) / F.col("total"), 6)).alias("span_recall8"),
        F.coalesce("nonempty", F.lit(0)).alias("nonempty"),
    )


def score_units(credits: DataFrame, units: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``query_id, ndcg8, span_recall8``: novelty of units that results earn by grades.

    ``credits``: ``query_id, rank, unit_id, grade`` achieved; ``units``: ``query_id, unit_id, grade``
    of the target. A result's gain is the largest improvement of any unit over earlier ranks.
    """
    top = credits.where(F.col("rank") <= depth).groupBy("query_id", "unit_id", "rank").agg(F.max(gain(F.col("grade"))).alias("gain"), F.max("grade").alias("grade"))
    earlier = Window.partitionBy("query_id", "unit_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    fresh = top.withColumn("fresh", F.greatest(F.lit(0.0), F.col("gain") - F.coalesce(F.max("gain").over(earlier), F.lit(0.0))))
    dcg = fresh.groupBy("query_id", "rank").agg(F.max("fresh").alias("fresh")).groupBy("query_id").agg(F.sum(_discounted(F.col("fresh"), F.col("rank"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "unit_id")
    ranked = units.where("grade > 0").withColumn("rank", F.row_number().over(order).cast("long"))
    ideal = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= depth, _discounted(gain(F.col("grade")), F.col("rank")))).alias("ideal"), F.count("*").alias("total"))
    best = top.groupBy("query_id", "unit_id").agg(F.max("grade").alias("achieved"))
    reached = units.where("grade > 0").join(best, ["query_id", "unit_id"]).where(F.col("achieved") >= F.col("grade")).groupBy("query_id").agg(F.count("*").alias("reached"))
    joined = ideal.join(dcg, "query_id", "left").join(reached, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg8"), F.round(F.coalesce("reached", F.lit(0)) / F.col("total"), 6).alias("span_recall8"))


def query_means(measurements: DataFrame, repetitions: int, value: str = "value") -> DataFrame:
    """``question, mean``: null unless all repetitions are there and known."""
    found = measurements.groupBy("question").agg(F.count("*").alias("n"), F.count(value).alias("known"), F.avg(value).alias("mean"))
    whole = (F.col("n") == repetitions) & (F.col("known") == repetitions)
    return found.select("question", F.when(whole, F.round("mean", 6)).alias("mean"))


def summarise(means: DataFrame, groups: list[str], value: str = "mean") -> DataFrame:
    """Overall and by each of ``groups``: ``scope, name, eligible, scored, missing, mean``."""
    sets = ", ".join(["()", *[f"(`{g}`)" for g in groups]])
    keys = ", ".join(f"`{g}`" for g in groups)
    scope = "CASE " + " ".join(f"WHEN grouping(`{g}`) = 0 THEN '{g}'" for g in groups) + " ELSE 'all' END"
    name = "coalesce(" + ", ".join(f"CASE WHEN grouping(`{g}`) = 0 THEN cast(`{g}` AS string) END" for g in groups) + ", '')"
    sql = f"SELECT {scope} AS scope, {name} AS name, count(*) AS eligible, count(`{value}`) AS scored, count(*) - count(`{value}`) AS missing, round(avg(`{value}`), 6) AS mean FROM {{means}} GROUP BY GROUPING SETS ({sets})"
    return means.sparkSession.sql(sql, means=means) if keys else means


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank median, 95th percentile and maximum of each group, and how many values it has.

    Values are numbered in the order of group and value over all tasks; a percentile is the value
    with a certain number. Nulls are left out; a group of nulls only has none.
    """
    known = numbered(rows.where(F.col(value).isNotNull()).select(group, value), [group, value])
    sizes = known.groupBy(F.col(group).alias("_key")).agg(F.min("number").alias("first"), F.count("*").alias("n"), F.max(value).alias("longest"))
    first, n = F.col("first"), F.col("n")
    wanted = sizes.select("*", (first + F.floor((n + 1) / 2) - 1).alias("at50"), (first + F.floor((n * 95 + 99) / 100) - 1).alias("at95"))
    wanted = wanted.select("_key", "n", "longest", "at50", "at95", F.explode(F.array("at50", "at95")).alias("number"))
    picked = wanted.join(known.select("number", F.col(value).alias("_value")), "number")  # two rows of a group
    own = [F.max(F.when(F.col("number") == F.col(at), F.col("_value"))).alias(k) for k, at in (("p50", "at50"), ("p95", "at95"))]
    found = picked.groupBy("_key").agg(*own, F.max("longest").alias("longest"), F.max("n").alias("n"))
    every = rows.select(F.col(group).alias("_group")).distinct()
    out = every.join(found, F.col("_group").eqNullSafe(F.col("_key")), "left")
    return out.select(F.col("_group").alias(group), "p50", "p95", "longest", F.coalesce("n", F.lit(0)).alias("n"))
