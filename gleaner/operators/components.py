"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest node it reaches.

    Nodes are longs. Self-loops, repeated edges and edges with a null end are allowed and
    change nothing; an empty input gives an empty result. Each step is two aggregations by
    node and one join, so no adjacency list is ever collected; the number of steps grows with
    the logarithm of the number of nodes. Each step is written to the shared folder.
    """
    u, v = F.col("u"), F.col("v")

    def pointed(df: DataFrame) -> DataFrame:
        """Edges from the larger to the smaller end, each once."""
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(u != v).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialise(pointed(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()), "cc")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = pointed(both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        now = materialise(pointed(small.unionByName(low.withColumnRenamed("m", "v"))), "cc")
        was, seen = seen, mark(now)
        if was == seen:
            break
    roots = now.select(v.alias("node"), v.alias("root")).distinct()
    return now.select(u.alias("node"), v.alias("root")).unionByName(roots)
