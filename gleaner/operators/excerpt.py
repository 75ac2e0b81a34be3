"""Best-window excerpts: the 400 characters that hold the rarest query terms.

A text's tokens, their parts and the parts' humps become rows with places, by running sums of
lengths. An occurrence of a wanted term lies in the windows whose first character is in one range;
what a term adds is the union of its ranges, and a running sum over the ends of all of these
gives the weight of every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import SEPARATORS, TOKEN, matches
from gleaner.session import materialise

SIZE = 400
#: Weights are added as whole numbers, so that no order of addition can change a window.
UNIT = 1e9

#: Fixed value: the border between two humps of a part.
HUMP_BORDER = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def _laid_out(rows: DataFrame, name: str, parts: Column, gaps: Column, keys: list[str], origin: Column, whole: str | None = None) -> DataFrame:
    """A row for each of ``parts``, which follow one another from ``origin``, each after its gap.

    Adds ``name``, its number ``<name>_no``, its first character ``<name>_at`` and the number of parts ``<name>s``. Rows are
    numbered within ``keys``. ``whole``, what is cut into parts, goes with the first of them only, so a text is never
    multiplied by its parts.
    """
    others = [c for c in rows.columns if c not in (whole, "text")]
    zipped = F.arrays_zip(parts.alias("part"), gaps.alias("gap"))
    out = rows.withColumn(f"{name}s", F.size(parts)).select("*", F.posexplode(zipped).alias(f"{name}_no", "laid"))
    first = [F.when(F.col(f"{name}_no") == 0, F.col(whole)).alias(whole)] if whole else []
    out = out.select(*others, *first, f"{name}s", f"{name}_no", F.col("laid.part").alias(name), (F.length("laid.gap") + F.length("laid.part")).alias("long")).where(F.col(name).isNotNull())
    upto = F.sum("long").over(Window.partitionBy(*keys).orderBy(f"{name}_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(f"{name}_at", origin + upto - F.length(name)).drop("long")


def occurrences(rows: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """``key, term, start, end`` of each token of the texts, of its parts and of their humps.

    ``key`` must tell the rows apart. Texts are not shuffled, only their tokens and lengths; a null text has none.
    """
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    tokens = _laid_out(texts, "token", matches(F.col("text")), F.split("text", TOKEN), ["key"], F.lit(0))
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all("token", F.lit(f"({SEPARATORS})"), F.lit(1)))
    pieces = _laid_out(tokens, "piece", F.split("token", SEPARATORS), gaps, ["key", "token_no"], F.col("token_at"), "token")
    humps = F.split("piece", HUMP_BORDER)
    humps = _laid_out(pieces, "hump", humps, F.transform(humps, lambda _: F.lit("")), ["key", "token_no", "piece_no"], F.col("piece_at"), "piece")

    def span(name: str, holds: Column) -> Column:
        at = F.col(f"{name}_at").cast("long")
        return F.when(holds, F.struct(F.lower(name).alias("term"), at.alias("start"), (at + F.length(name)).alias("end")))

    first = F.col("hump_no") == 0
    spans = F.array(span("token", first & (F.col("piece_no") == 0)), span("piece", first & (F.col("pieces") > 1)), span("hump", F.col("humps") > 1))
    return humps.select("key", F.explode(F.array_compact(spans)).alias("x")).select("key", "x.*")


def best_windows(spans: DataFrame) -> DataFrame:
    """``key, first`` of ``spans`` (key, term, start, end, weight, width).

    ``first`` begins the window of ``width`` characters with the greatest weight of distinct terms, the first of equals.
    Weights are whole numbers above 0, and a span may occur repeatedly. Keys without a span that fits into a window are left out.
    """
    ranges = spans.where("end - start <= width").select("key", "term", "weight", F.greatest(F.lit(0), F.col("end") - F.col("width")).alias("low"), F.col("start").alias("high"))
    before = F.max("high").over(Window.partitionBy("key", "term").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("low", F.greatest("low", F.coalesce(before + 1, F.lit(0)))).where("low <= high")
    steps = F.array(F.struct(F.col("low").alias("first"), F.col("weight").alias("step")), F.struct((F.col("high") + 1).alias("first"), (-F.col("weight")).alias("step")))
    steps = fresh.select("key", F.explode(steps).alias("x")).groupBy("key", "x.first").agg(F.sum("x.step").alias("step"))
    total = F.sum("step").over(Window.partitionBy("key").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.select("key", F.struct((-total).alias("less"), "first").alias("x")).groupBy("key").agg(F.min("x")["first"].alias("first"))


def excerpts(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` with ``start, end, snippet``; ``rows`` has ``text`` and ``weights`` (term to weight).

    An ellipsis stands where the text goes on. Texts without a weighted term, or with terms longer
    than ``size`` only, are shown from their beginning; null texts as empty ones. Terms without a weight
    above 0 don't count. Repeated rows are shown alike. Meant for results of a search, a few for each query.
    """
    names = [F.col(f"`{c}`") for c in rows.columns if c not in ("text", "weights")]
    held = rows.select(F.struct(*names).alias("row") if names else F.struct(F.lit(0)).alias("row"), F.coalesce("text", F.lit("")).alias("text"), "weights")
    held = materialise(held.withColumn("key", F.monotonically_increasing_id()), "shown")
    wanted = held.select("key", F.least(F.lit(size), F.length("text")).alias("width"), F.explode("weights").alias("term", "weight"))
    wanted = materialise(wanted.withColumn("weight", F.round(F.col("weight") * UNIT).cast("long")).where("weight > 0"), "wanted")
    found = occurrences(held.where(F.size("weights") > 0)).join(wanted, ["key", "term"])
    placed = held.join(best_windows(found), "key", "left")
    start, length = F.coalesce("first", F.lit(0)).cast("long"), F.length("text")
    end = start + F.least(F.lit(size), length)
    dots = lambda holds: F.when(holds, "…").otherwise("")
    snippet = F.concat(dots(start > 0), F.substring("text", start.cast("int") + 1, F.lit(size)), dots(end < length))
    return placed.select(*(["row.*"] if names else []), start.alias("start"), end.alias("end"), snippet.alias("snippet"))
