"""Numbers of rows in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.session import materialise


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their number, from 0, in ``order``; equal rows are numbered in any order.

    Rows are range-partitioned and sorted by ``order``, ties spread by a further key, and written
    with their place; the partitions' counts, one row each, are summed up to give the first numbers.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    placed = spread.drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    within = F.col("_place") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")
