"""All places of many texts in many others, by one automaton and one scan."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialise

#: Bytes of patterns that are sent to every task at once.
BLOCK = 32 << 20


def _scan(texts: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """``id, pattern_no, start, end`` of the places of ``patterns`` in ``texts`` (id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)
    kind = texts.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for number, pattern in shared.value:
            automaton.add_word(pattern, (number, len(pattern)))
        automaton.make_automaton()
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                found = [(number, last + 1 - size, last + 1) for last, (number, size) in automaton.iter(text)] if text else []
                for at in range(0, len(found), 100_000):
                    part = found[at : at + 100_000]
                    ids = pa.array([batch.column(0)[k].as_py()] * len(part), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in zip(*part)]], ["id", "pattern_no", "start", "end"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind.simpleString()}, pattern_no long, start long, end long")


def places(patterns: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pattern, id, start, end``: every place of each distinct ``pattern`` in ``texts`` (id, text), overlapping ones too.

    A place is where the characters are, whatever stands around them. Null and empty patterns and texts
    have no places; rows of ``texts`` that share an id each give theirs. Patterns are taken in blocks of at
    most ``block`` bytes (or one pattern), each of which is sent to all tasks and scans the texts once;
    up to that size there is one scan.
    """
    spark = texts.sparkSession
    size = F.octet_length("pattern").cast("long")
    known = patterns.select("pattern").where(F.length("pattern") > 0).distinct()
    known = materialise(known.withColumn("pattern_no", F.monotonically_increasing_id()), "patterns")
    total = known.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-2 * total // block)) if total > block else 1
    out = None
    for k in range(blocks):  # a hash deals them, so a block of half the size on average stays below the bound
        own = known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k) if blocks > 1 else known
        rows = [(r["pattern_no"], r["pattern"]) for r in own.toLocalIterator()]
        if rows:
            found = _scan(texts, rows)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.where("false").select(F.col("text").alias("pattern"), "id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return out.join(known, "pattern_no").select("pattern", "id", "start", "end")
