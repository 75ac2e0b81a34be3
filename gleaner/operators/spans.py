"""Joins of spans and positions: containment, overlap, and exact places of a text in others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.patterns import places

#: Width of the bins by which spans are joined.
BIN = 1024


def _binned(spans: DataFrame, name: str) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor(F.greatest("end", F.col("start")) / BIN))
    return spans.withColumn(name, F.explode(bins))


def contained(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans of equal ``keys`` where the outer contains the inner.

    The inner span's first bin is one of the outer's, so it is dealt once and each pair is found once.
    """
    left = _binned(outer.withColumnsRenamed({c: f"outer_{c}" for c in outer.columns if c not in (*keys, "start", "end")}), "bin").withColumnsRenamed({"start": "outer_start", "end": "outer_end"})
    right = inner.withColumnsRenamed({c: f"inner_{c}" for c in inner.columns if c not in keys}).withColumn("bin", F.floor(F.col("inner_start") / BIN))
    inside = (F.col("outer_start") <= F.col("inner_start")) & (F.col("outer_end") >= F.col("inner_end"))
    return left.join(right, [*keys, "bin"]).where(inside).drop("bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans of equal ``keys`` that overlap, each once: in the later of their first bins."""
    left = _binned(a, "bin").withColumnsRenamed({c: f"a_{c}" for c in a.columns if c not in keys})
    right = _binned(b, "bin").withColumnsRenamed({c: f"b_{c}" for c in b.columns if c not in keys})
    meets = (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    first = F.col("bin") == F.floor(F.greatest("a_start", "b_start") / BIN)
    return left.join(right, [*keys, "bin"]).where(meets & first).drop("bin")


def locate_texts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, id, start, end, unique_in_text``: where ``items`` (item_id, text) stand verbatim in ``docs`` (id, text).

    All items are looked for in one scan of the texts, so also those without a word. ``start`` is the first
    place; ``unique_in_text`` is false if there is a second, be it one that overlaps the first.
    """
    found = places(items.select(F.col("text").alias("pattern")), docs)
    first = found.groupBy("pattern", "id").agg(F.min("start").alias("start"), F.min("end").alias("end"), (F.count("*") == 1).alias("unique_in_text"))
    return items.select("item_id", F.col("text").alias("pattern")).join(first, "pattern").select("item_id", "id", "start", "end", "unique_in_text")


def line_starts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``rows``, for each line of its text, with ``line`` (from 1) and ``start``, its first character.

    Starts are running sums of line lengths; lines themselves are not shuffled. An empty text has one
    line, a null text none; repeated rows have their lines each.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != text]
    tagged = rows.select(F.struct(F.lit(0), *others).alias("row"), F.col(f"`{text}`").alias("text")).withColumn("tag", F.monotonically_increasing_id())
    lines = tagged.select("row", "tag", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)).alias("no", "n"))
    upto = F.sum("n").over(Window.partitionBy("tag").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = lines.select("row", (F.col("no") + 1).cast("long").alias("line"), (upto - F.col("n")).alias("start"))
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c != text], "line", "start")
