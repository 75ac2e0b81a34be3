"""Incremental preparation from a stream of sources: every micro-batch publishes a generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.plans.index import _read, prepare
from gleaner.sources.markdown import Budget
from gleaner.sources.providers import Embedding


def prepare_stream(spark: SparkSession, sources: DataFrame, root: str, provider: Embedding, checkpoint: str, project: str = "project", budget: Budget = Budget()) -> StreamingQuery:
    """Keep the index at ``root`` up to date with a stream of ``source, text, version``.

    Of a source the row with the largest version counts, the later of equal ones; a null text removes
    it. Each batch writes, under its number, the newest row of every source from what the batch before
    left, so it reads no other batch, and a batch that is repeated gives the same.
    """
    schema = "source string, text string, version long"

    def publish(batch: DataFrame, number: int) -> None:
        before = _read(spark, f"{root}/newest/{number - 1}", schema).withColumn("late", F.lit(0))
        rows = before.unionByName(batch.select("source", "text", "version").withColumn("late", F.lit(1)))
        newest = rows.groupBy("source").agg(F.max_by(F.struct("text", "version"), F.struct("version", "late")).alias("r")).select("source", "r.text", "r.version")
        newest.write.mode("overwrite").parquet(f"{root}/newest/{number}")
        known = spark.read.schema(schema).parquet(f"{root}/newest/{number}")
        prepare(spark, known.where("text is not null").select("source", "text"), root, provider, project, budget)

    return sources.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
