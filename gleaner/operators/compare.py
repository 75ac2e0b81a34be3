"""Paired comparison of two systems, bootstrap intervals, release gates, costs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.numbering import numbered
from gleaner.session import materialise

#: Draws of a resample that are made at once.
DRAWS = 1 << 15
#: Deltas of a block, draws of a slice of the resamples, and slices at most, so that blocks are sent a bounded number of times.
BLOCK, SLICE, SLICES = 1 << 20, 1 << 24, 32
#: The generator of the resamples, its seed, and the resamples.
A, C, M, SEED, SAMPLES = 1664525, 1013904223, 2**32, 20260905, 2000


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """``question, delta`` of questions that both (question, mean) know."""
    both = left.select("question", F.col("mean").alias("l")).join(right.select("question", F.col("mean").alias("r")), "question")
    return both.where("l is not null and r is not null").select("question", (F.col("r") - F.col("l")).alias("delta"))


def outcome(pairs: DataFrame) -> DataFrame:
    """One row: ``questions, wins, ties, losses, mean_delta``."""
    d = F.col("delta")
    return pairs.agg(F.count("*").alias("questions"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg(d), 6).alias("mean_delta"))


def jump(state: int, steps: int) -> int:
    """The generator's state after ``steps``."""
    a, c = A, C
    while steps:
        if steps & 1:
            state = (a * state + c) % M
        a, c = a * a % M, (a + 1) * c % M
        steps >>= 1
    return state


def _successors(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms that lead from a state to each of its first ``steps`` successors."""
    factors, terms, a, c = np.empty(steps, np.uint64), np.empty(steps, np.uint64), 1, 0
    for k in range(steps):
        a, c = a * A % M, (c * A + C) % M
        factors[k], terms[k] = a, c
    return factors, terms


def _resample(deltas: np.ndarray, n: int, at: int, samples: range, seed: int, draws: int) -> np.ndarray:
    """For each sample and row of ``deltas`` the sum of the drawn ones. A row has those of numbers from ``at`` of the ``n`` of a group."""
    factors, terms = _successors(min(draws, n))
    state, ahead, out = jump(seed, samples.start * n), n % draws or draws, np.zeros((len(samples), len(deltas)))
    whole, rest = (_jumps(k) for k in (min(draws, n), min(ahead, n)))
    for k in range(len(samples)):
        for first in range(0, n, draws):
            size = min(draws, n - first)
            states = (factors[:size] * np.uint64(state) + terms[:size]) % np.uint64(M)
            number = np.floor(states / float(M) * n).astype(np.int64) - at
            if deltas.shape[1] < n:
                number = number[(number >= 0) & (number < deltas.shape[1])]
            out[k] += deltas[:, number].sum(axis=1)
            a, c = whole if size == min(draws, n) else rest
            state = (a * state + c) % M
    return out


def _jumps(steps: int) -> tuple[int, int]:
    """Factor and term that lead from a state to its successor after ``steps``."""
    c = jump(0, steps)
    return (jump(1, steps) - c) % M, c


def bootstrap_groups(pairs: DataFrame, by: list[str], samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """``*by, low, high``: the 95 % interval of each group's mean delta over paired resamples.

    ``pairs``: ``*by, question, delta``; nulls are left out, and groups without deltas have no row. All
    resamples of a group draw from one sequence of the generator, each from its own part of it, and
    the sequence depends on the number of deltas only. Deltas are numbered in the order of the questions and packed
    into blocks: of a large group ``BLOCK`` numbers, of small groups with equally many deltas several groups, which share their
    draws. A block is met by a slice of the resamples in one row, whose draws are made and
    summed in the task; only the sums leave it. No row and no task holds all questions, and nothing comes to the driver.
    """
    rows = numbered(pairs.where("delta is not null").select(*by, "question", F.col("delta").cast("double").alias("delta")), [*by, "question"])
    rows = materialise(rows, "deltas")
    groups = rows.groupBy(*by).agg(F.min("number").alias("_first"), F.count("*").alias("_n"))
    turn = F.row_number().over(Window.partitionBy("_n").orderBy("_first")) - 1
    groups = materialise(groups.withColumn("_pack", F.floor(turn / F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("_n"))))), "groups")
    named = groups.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "_first", "_n", "_pack")
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    number = F.col("number") - F.col("_first")
    placed = rows.join(named, same).select("_n", "_pack", F.floor(number / BLOCK).alias("_block"), "_first", (number % BLOCK).alias("number"), "delta")

    def pack(part: pa.Table) -> pa.Table:
        first, own = np.unique(part.column("_first").to_numpy(), return_inverse=True)
        n, block = part.column("_n")[0].as_py(), part.column("_block")[0].as_py()
        deltas = np.empty((len(first), min(BLOCK, n - block * BLOCK)))
        deltas[own, part.column("number").to_numpy()] = part.column("delta").to_numpy()
        return pa.table({"_n": [n], "_block": [block], "_firsts": [first.tobytes()], "_deltas": pa.array([deltas.tobytes()], pa.binary())})

    packed = placed.groupBy("_n", "_pack", "_block").applyInArrow(pack, "_n long, _block long, _firsts binary, _deltas binary")
    slices = F.least(F.lit(SLICES), F.lit(samples), F.ceil(F.col("_n") * samples / SLICE)).cast("int")
    work = materialise(packed, "packed").withColumn("_slices", slices).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    work = work.repartition(SLICES, "_n", "_block", "_firsts", "_slice")
    draws = DRAWS

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, block, slices, own = (batch.column(c)[k].as_py() for c in ("_n", "_block", "_slices", "_slice"))
                first = np.frombuffer(batch.column("_firsts")[k].as_buffer(), np.int64)
                deltas = np.frombuffer(batch.column("_deltas")[k].as_buffer(), np.float64).reshape(len(first), -1)
                part = range(own * samples // slices, (own + 1) * samples // slices)
                sums = _resample(deltas, n, block * BLOCK, part, seed, draws)
                out = [np.tile(first, len(part)), np.repeat(np.arange(part.start, part.stop), len(first)), sums.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["_first", "sample", "sum"])

    sums = work.mapInArrow(draw, "_first long, sample long, sum double").groupBy("_first", "sample").agg(F.sum("sum").alias("sum"))
    ordered = sums.join(groups.select("_first", "_n"), "_first").groupBy("_first").agg(F.array_sort(F.collect_list(F.col("sum") / F.col("_n"))).alias("m"))  # as many as there are resamples
    low, high = int(samples * 0.025), int(samples * 0.975)
    return groups.join(ordered, "_first").select(*by, F.round(F.get("m", F.lit(low)), 6).alias("low"), F.round(F.get("m", F.lit(high)), 6).alias("high"))


def bootstrap(pairs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row: ``low, high``, as :func:`bootstrap_groups` with all pairs in one group; nulls without pairs."""
    found = bootstrap_groups(pairs.withColumn("all", F.lit(0)), ["all"], samples, seed)
    return pairs.sparkSession.range(1).select(F.lit(0).alias("all")).join(found, "all", "left").select("low", "high")


def compare_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``*by, questions, wins, ties, losses, mean_delta, low, high, missing`` of each group.

    Both sides: ``*by, question, mean``, a row for each question of a group at most. A question is missing if a
    side lacks it or doesn't know its mean.
    """
    both = left.select(*by, "question", F.col("mean").alias("l")).join(right.select(*by, "question", F.col("mean").alias("r")), [*by, "question"], "full")
    pairs = materialise(both.select(*by, "question", (F.col("r") - F.col("l")).alias("delta")), "pairs")
    d = F.col("delta")
    counts = [F.count("delta").alias("questions"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.count_if(d.isNull()).alias("missing")]
    found = pairs.groupBy(*by).agg(*counts).join(bootstrap_groups(pairs, by), by, "left")
    return found.select(*by, "questions", "wins", "ties", "losses", "mean_delta", "low", "high", "missing")


def gates(measured: DataFrame, rules: DataFrame) -> DataFrame:
    """``gate, status``: PASS, FAIL, or INCONCLUSIVE where the measure is null or missing.

    ``measured``: ``gate, value``; ``rules``: ``gate, sense`` (``at_least`` or ``at_most``), ``bound``.
    """
    joined = rules.join(measured, "gate", "left")
    holds = F.when(F.col("sense") == "at_least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return joined.select("gate", F.when(F.col("value").isNull(), "INCONCLUSIVE").when(holds, "PASS").otherwise("FAIL").alias("status"))


def decision(checked: DataFrame) -> DataFrame:
    """One row: ``decision``, ROLLOUT if every gate passes."""
    return checked.agg(F.when(F.every(F.col("status") == "PASS"), "ROLLOUT").otherwise("NO_ROLLOUT").alias("decision"))


def costs(attempts: DataFrame, group: str, cost: str) -> DataFrame:
    """Known costs and the number of unknown ones, which count as unknown and not as nothing."""
    return attempts.groupBy(group).agg(F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 6).alias("known"), F.count_if(F.col(cost).isNull()).alias("unknown"))
