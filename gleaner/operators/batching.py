"""Greedy batches of inputs for a model: by count and by tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(sizes: Iterable[int], most: int, tokens: int) -> list[int]:
    """The number of each input's batch: a batch ends before it would exceed ``most`` inputs or ``tokens``."""
    out, count, total, batch = [], 0, 0, 0
    for n in sizes:
        if n > tokens:
            raise ValueError(f"an input of {n} tokens is over the bound")
        if count and (count >= most or total + n > tokens):
            count, total, batch = 0, 0, batch + 1
        count, total = count + 1, total + n
        out.append(batch)
    return out


def batch_inputs(inputs: DataFrame, most: int = 32, tokens: int = 32_768) -> DataFrame:
    """``inputs`` (with ``tokens``) with ``partition, batch``: a batch ends before it would exceed a bound.

    Batches are filled in the order of the rows of a partition; each task sends its own batches,
    so they need not be filled across tasks. An input over the bound of tokens is an error.
    """
    names = inputs.columns
    at = names.index("tokens")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = total = batch = 0
        for part in parts:
            numbers = []
            for n in part.column(at).to_pylist():
                if n > tokens:
                    raise ValueError(f"an input of {n} tokens is over the bound")
                if count and (count >= most or total + n > tokens):
                    count, total, batch = 0, 0, batch + 1
                count, total = count + 1, total + n
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int64())], [*names, "batch"])

    kinds = ", ".join(f"`{c}` {inputs.schema[c].dataType.simpleString()}" for c in names)
    return inputs.mapInArrow(run, f"{kinds}, batch long").withColumn("partition", F.spark_partition_id())
