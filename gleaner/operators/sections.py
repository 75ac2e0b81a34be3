"""Sections of Markdown texts, with the headings above them, by lines as rows.

A pattern finds fenced blocks, which are rows of their own. What of a heading depends on other
lines comes from windows over the lines of a text: the line after a title, the parity within a
run of underlines, and of each level the last heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import JS_SPACE, lf

#: White space within a line, and Markdown's own forms of fences and headings.
INLINE_SPACE = JS_SPACE.replace("\\n", "")
LINE_START, LINE_END = r"(?<![^\n])", r"(?:\n|\z)"
FENCE_OPENS = rf"{LINE_START} {{0,3}}(([`~])\2{{2,}}+)(?:(?<=`)[^`\n]*+|(?<=~)[^\n]*+){LINE_END}"
FENCE_CLOSES = rf"{LINE_START} {{0,3}}\1\2*+{INLINE_SPACE}*+{LINE_END}"
FENCED = rf"{FENCE_OPENS}[\s\S]*?(?:{FENCE_CLOSES}|\z)"
ATX = r"^ {0,3}(#{1,6})(?:[ \t]+([^\n\r\u2028\u2029]*?)|[ \t]*)\z"
CLOSING_HASHES = r"(?:^|[ \t]+)#+[ \t]*\z"
UNDERLINE = rf"^ {{0,3}}(=+|-+){INLINE_SPACE}*\z"
SHOWN = JS_SPACE.replace("[", "[^", 1)
EDGES = rf"^{JS_SPACE}+|{JS_SPACE}+\z"
MARK, LEVELS = "\ufeff", 6


def lines(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """``key, at, piece, fenced``: the lines of each text with their ends, a fenced block as one row.

    ``at`` numbers the rows of a text. Line ends count as line feeds. A null text has no rows, as an
    empty one. A byte-order mark is part of the first line.
    """
    given = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("given"))
    whole = given.select("key", F.when(F.col("given").contains("\r"), lf(F.col("given"))).otherwise(F.col("given")).alias("whole"))
    # a mark is taken off while fences are looked for, since it hides the start of the first line
    marked = F.col("whole").startswith(MARK)
    bare = whole.select("key", marked.alias("marked"), F.when(marked, F.substring("whole", 2, 2**31 - 1)).otherwise(F.col("whole")).alias("body"))
    # few texts have fences, so only what may have one is searched by pattern
    body, fences = F.col("body"), F.col("body").contains("```") | F.col("body").contains("~~~")
    parted = F.arrays_zip(F.split(body, FENCED, -1).alias("open"), F.regexp_extract_all(body, F.lit(FENCED), F.lit(0)).alias("fence"))
    zipped = F.when(fences, parted).otherwise(F.array(F.struct(body.alias("open"), F.lit(None).cast("string").alias("fence"))))

    def piece(value: Column, fenced: bool) -> Column:
        return F.struct(value.alias("piece"), F.lit(fenced).alias("fenced"))

    def ended(some: Column) -> Column:
        return F.transform(some, lambda y, k: piece(F.when(k < F.size(some) - 1, F.concat(y, F.lit("\n"))).otherwise(y), False))

    parts = F.transform(zipped, lambda x: F.concat(F.flatten(F.transform(F.array(F.split(x["open"], "\n", -1)), ended)), F.array(piece(F.coalesce(x["fence"], F.lit("")), True))))
    rows = F.filter(F.flatten(parts), lambda x: x["piece"] != "")
    laid = bare.select("key", "marked", F.posexplode_outer(rows).alias("at", "x")).where("at IS NOT NULL OR marked")
    at, own = F.coalesce("at", F.lit(0)), F.coalesce("x.piece", F.lit(""))
    return laid.select("key", at.alias("at"), F.when(F.col("marked") & (at == 0), F.concat(F.lit(MARK), own)).otherwise(own).alias("piece"), F.coalesce("x.fenced", F.lit(False)).alias("fenced"))


def headed(rows: DataFrame) -> DataFrame:
    """Rows of ``lines`` with ``start`` (characters before), ``line`` (lines before), ``section`` and ``headings``."""
    order = Window.partitionBy("key").orderBy("at")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.when(~F.col("fenced"), 1).otherwise(F.length("piece") - F.length(F.replace("piece", F.lit("\n"))) + F.when(F.col("piece").endswith("\n"), 0).otherwise(1))
    unended = F.when(F.col("piece").endswith("\n"), F.substring("piece", F.lit(1), F.length("piece") - 1)).otherwise(F.col("piece"))
    bare = F.when((F.col("at") == 0) & F.col("piece").startswith(MARK), F.substring(unended, 2, 2**31 - 1)).otherwise(unended)
    flat = rows.withColumn("bare", F.when(~F.col("fenced"), bare))
    # the first sign of a line tells most lines from headings, before any pattern is tried
    sign = F.substring(F.ltrim(F.substring("bare", 1, 4)), 1, 1)
    seen = flat.withColumn("atx", F.coalesce((sign == "#") & F.col("bare").rlike(ATX), F.lit(False))).withColumn("under", F.coalesce(sign.isin("=", "-") & F.col("bare").rlike(UNDERLINE), F.lit(False)))
    plain = ~F.col("fenced") & ~F.col("atx") & ~F.col("bare").startswith("    ") & ~F.col("bare").startswith("\t") & F.col("bare").rlike(SHOWN)
    seen = seen.withColumn("plain", F.coalesce(plain, F.lit(False)))
    # of a line that isn't an underline: whether it may take the first underline after it
    base = F.last(F.when(~F.col("under"), F.struct("at", "plain")), ignorenulls=True).over(sofar)
    seen = seen.select(
        "key", "at", "piece", "bare", "atx", "under", "plain", base.alias("base"), F.lead("bare").over(order).alias("after"), F.coalesce(F.lead("under").over(order), F.lit(False)).alias("underlined"),
        (F.sum(F.length("piece")).over(sofar) - F.length("piece")).alias("start"), (F.sum(breaks).over(sofar) - breaks).alias("line"),
    )
    # in a run of underlines every second one is a title's, so the others may be titles
    run = F.col("at") - F.coalesce(F.col("base.at"), F.lit(-1))
    taken = F.coalesce(F.col("base.plain"), F.lit(False)).cast("int")
    setext = F.col("plain") & F.col("underlined") & (~F.col("under") | ((run + taken) % 2 == 1))
    hashes = F.length(F.regexp_extract("bare", ATX, 1))
    level = F.when(F.col("atx"), hashes).when(setext, F.when(F.regexp_extract("after", UNDERLINE, 1).startswith("="), 1).otherwise(2))
    title = F.when(F.col("atx"), F.regexp_replace(F.regexp_extract("bare", ATX, 2), CLOSING_HASHES, "")).otherwise(F.col("bare"))
    told = seen.select("key", "at", "piece", "start", "line", level.alias("level"), F.when(level.isNotNull(), F.regexp_replace(title, EDGES, "")).alias("title"))
    last = [F.last(F.when(F.col("level") == k, F.struct("at", "title")), ignorenulls=True).over(sofar).alias(f"h{k}") for k in range(1, LEVELS + 1)]
    told = told.select("key", "at", "piece", "start", "line", F.count("level").over(sofar).alias("section"), *last)
    # a heading is above a line while none of its level's betters has come after it
    above = [F.when(F.col(f"h{k}.at") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"h{j}.at"), F.lit(-1)) for j in range(1, k)]), F.col(f"h{k}.title")) for k in range(1, LEVELS + 1)]
    return told.select("key", "at", "piece", "start", "line", "section", F.array_compact(F.array(*above)).alias("headings"))


def sections(texts: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """``key, section, start, line, headings, body`` of each section of the texts, in characters and lines before it.

    A section begins at a heading, or at the start of its text, and its body reaches to the next heading. ``headings``
    has its own and those above it. ``key`` must tell the rows apart. Null and empty texts have none. Other columns aren't read.
    Lines are shuffled once, by their text.
    """
    rows = headed(lines(texts, key, text))
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]))
    found = rows.groupBy("key", "section").agg(F.min("start").alias("start"), F.min("line").alias("line"), F.first("headings").alias("headings"), body.alias("body"))
    return found.select(F.col("key").alias(key), "section", F.col("start").cast("long").alias("start"), F.col("line").cast("long").alias("line"), "headings", "body")
