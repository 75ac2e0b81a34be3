"""How filters interact: what each removes in every order, evaluated in long form with windows.

1. Every document gets a mask, a bit for each filter that it fails. A filter "repeats a smaller
   id's text" needs other rows: rows are counted by digest and id, and the smallest id of each
   digest is joined back by both, so no task holds all copies of a text.
2. Masks are counted by part: at most ``2 ** filters`` cells a part, whatever the input.
3. Cells are unpivoted against the steps of every order of the filters. A running bit-or over the
   steps of a cell and order tells which filters failed it earlier; conditional sums over cells
   give the figures of a step, and a window over a filter's steps in all orders gives its total.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.tasks import column
from gleaner.session import materialise

WORD_BREAK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter that a text fails which a smaller id has too; :func:`text_failures` has the others.
REPEATED = "E"


def text_failures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with ``words``, its words, and the failure conditions on a text by letter."""
    text = F.coalesce(column(text_col), F.lit(""))
    packed = docs.withColumn("words", F.filter(F.split(text, WORD_BREAK), lambda w: w != ""))
    words, letters = F.size("words").cast("long"), F.length(text).cast("long")
    return packed, {
        "A": words < 200,
        "B": 100 * F.size(F.array_distinct("words")).cast("long") < 50 * words,
        "C": 100 * (letters - F.length(F.translate(text, CAPITALS, ""))) > 2 * letters,
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str, letters: str) -> int:
    return 1 << letters.index(letter)


def masked(docs: DataFrame, labels: DataFrame, letters: str, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail just the filters of ``mask``,
    and how many of them are labelled good or toxic."""
    own = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"), column(text_col).alias("text"))
    own, fails = text_failures(own)
    mask = sum((F.when(fails[x], bit(x, letters)).otherwise(0) for x in letters if x != REPEATED), F.lit(0))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = own.select("doc_id", "part", F.unhex(digest).alias("digest"), mask.cast("int").alias("mask"))
    rows = materialise(found.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    same = (F.col("r.digest") == F.col("f.digest")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))
    repeated = F.when(F.col("is_first"), 0).otherwise(bit(REPEATED, letters) if REPEATED in letters else 0)
    full = rows.alias("r").join(first.alias("f"), same, "left").select("r.doc_id", "part", "n", F.col("mask").bitwiseOR(repeated).alias("mask"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    # rows without an id have no label, and stay out of the join: they could all be one key
    known = full.where("doc_id is not null").join(said, "doc_id", "left")
    rest = full.where("doc_id is null").select("*", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    of = lambda flag: F.sum(F.col("n") * F.coalesce(flag, F.lit(0)))
    return known.unionByName(rest).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def evaluate(cells: DataFrame, letters: str) -> DataFrame:
    """The figures of every step of every order, from :func:`masked` counts."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = cells.withColumn("filter_order", F.explode(orders))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    at = F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)")
    long = long.withColumn("step", F.col("place") + 1).withColumn("failed", F.col("mask").bitwiseAND(at)).withColumn("only", F.col("mask") == at)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    alive, fails = F.col("earlier") == 0, F.col("failed") != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("only")).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"),
        total(alive & fails, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit_filters(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Audit the filters ``letters`` over all orders, a row for each part, order and step.

    Returns ``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; :func:`text_failures` and ``REPEATED`` say what a filter is. Null texts are
    empty ones. A null id ranks after all others, so such a row repeats any row of its text that
    has an id, and has no label. Rows that share an id don't repeat each other; of several
    labels of an id any counts. A null part and the empty one are one part. Labels and columns beside the
    named ones change nothing, whatever their names. An empty table gives no rows. ``shapley`` is
    the sum over all orders, not their mean.
    """
    return evaluate(materialise(masked(docs, labels, letters, part_col, id_col, text_col), "cells"), letters)
