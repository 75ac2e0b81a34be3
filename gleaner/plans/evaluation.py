"""A judged evaluation from captures to a decision: cohorts, metrics, summaries, comparisons, gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import line_of
from gleaner.operators.compare import compare_groups
from gleaner.operators.judgments import METRICS, question_means, score_renderings, select_cohorts, summarise_questions
from gleaner.operators.metrics import percentiles
from gleaner.operators.patterns import places
from gleaner.session import materialise


@dataclass(frozen=True)
class Bounds:
    """What a proposal must reach: against each comparator (metric to least mean delta), and by itself."""

    deltas: dict[str, dict[str, float]] = field(default_factory=dict)
    lower: float = 0.0
    slice_metric: tuple[str, str] = ("identifiers", "useful8")
    harm: dict[str, int] = field(default_factory=lambda: {"nonempty": 0, "misleading": 0})
    elapsed_p95: float = 15_000.0
    cost_p95: float = 0.002
    failures: int = 1
    unknown_costs: int = 0


@dataclass
class Review:
    """What reviewers decided: ``units``, ``renderings`` and ``credits`` (see ``score_renderings``)."""

    units: DataFrame
    renderings: DataFrame
    credits: DataFrame


def measure(questions: DataFrame, review: Review, captures: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Metrics of the captures of one cohort (question, failed, elapsed_ms, known_usd, unknown_attempts).

    ``excerpts``: question, rank, source, text, start, end. A displayed excerpt that nobody
    reviewed leaves its capture unresolved.
    """
    observed = captures.withColumn("repetition", F.lit(0))
    shown = excerpts.join(captures.select("question"), "question", "left_semi").select("question", F.lit(0).alias("repetition"), "rank", "source", "text", "start", "end")
    scored = score_renderings(questions, review.units, review.renderings, review.credits, observed.select("question", "repetition", "failed"), shown)
    return scored.join(captures.select("question", "elapsed_ms", "known_usd", "unknown_attempts"), "question")


def compare_cohorts(questions: DataFrame, means: DataFrame, proposals: tuple[str, ...], bounds: Bounds) -> DataFrame:
    """``proposal, comparator, metric, questions, wins, ties, losses, mean_delta, low, high, missing``: all comparisons in one pass.

    ``means``: cohort, question, metric, mean. Metrics of harm are compared over unanswerable questions, all
    others over answerable ones.
    """
    wanted = [(p, c, m, m not in ("nonempty", "misleading")) for p in proposals for c, deltas in bounds.deltas.items() for m in deltas]
    table = F.broadcast(questions.sparkSession.createDataFrame(wanted, "proposal string, comparator string, metric string, answerable boolean"))
    fits = means.join(questions.select("question", "answerable"), "question")

    def side(name: str) -> DataFrame:
        return fits.withColumnRenamed("cohort", name).join(table, [name, "metric", "answerable"]).select("proposal", "comparator", "metric", "question", "mean")

    return compare_groups(side("comparator"), side("proposal"), ["proposal", "comparator", "metric"])


def _status(passes: Column, unknown: Column) -> Column:
    return F.when(F.coalesce(unknown, F.lit(True)), "INCONCLUSIVE").when(passes, "PASS").otherwise("FAIL").alias("status")


def _gate(row: DataFrame, name: str, status: Column) -> DataFrame:
    return row.select(F.lit(name).alias("gate"), status)


def quality_gates(comparisons: DataFrame, bounds: Bounds) -> DataFrame:
    """``gate, status`` of each comparison (comparator, metric, ...): the mean delta and the low end reach their bounds.

    A comparison that isn't there is inconclusive.
    """
    least = [(c, m, float(x)) for c, deltas in bounds.deltas.items() for m, x in deltas.items()]
    rules = comparisons.sparkSession.createDataFrame(least, "comparator string, metric string, least double")
    joined = rules.join(comparisons, ["comparator", "metric"], "left")
    passes = (F.col("mean_delta") >= F.col("least")) & (F.col("low") >= bounds.lower)
    return joined.select(F.concat_ws(".", "comparator", "metric").alias("gate"), _status(passes, (F.col("questions") == 0) | (F.col("missing") > 0)))


def slice_gate(summary: DataFrame, baseline: DataFrame, bounds: Bounds) -> DataFrame:
    """The proposal is no worse than the baseline in one slice."""
    name, metric = bounds.slice_metric
    own = lambda s: s.where((F.col("scope") == "slice") & (F.col("name") == name) & (F.col("metric") == metric)).agg(F.max("mean").alias("mean"), F.max("missing").alias("missing"))
    row = own(summary).join(F.broadcast(own(baseline).withColumnsRenamed({"mean": "b_mean", "missing": "b_missing"})))
    unknown = F.col("mean").isNull() | F.col("b_mean").isNull() | (F.col("missing") + F.col("b_missing") > 0)
    return _gate(row, f"{name}.{metric}", _status(F.col("mean") >= F.col("b_mean"), unknown))


def harm_gates(questions: DataFrame, measured: DataFrame, baseline: DataFrame, bounds: Bounds) -> DataFrame:
    """Unanswerable questions that show something, or mislead: within a bound, and no more than the baseline's."""
    total = questions.where(~F.col("answerable")).agg(F.count("*").alias("total"))
    out = None
    for metric, most in bounds.harm.items():
        own = lambda m, n, metric=metric: m.agg(F.coalesce(F.sum(metric), F.lit(0)).alias(n), F.count(metric).alias(f"{n}_known"))
        row = own(measured, "got").join(F.broadcast(own(baseline, "was"))).join(F.broadcast(total))
        unknown = (F.col("got_known") != F.col("total")) | (F.col("was_known") != F.col("total"))
        status = F.when(F.col("got") > most, "FAIL").when(unknown, "INCONCLUSIVE").when(F.col("got") <= F.col("was"), "PASS").otherwise("FAIL")
        gate = _gate(row, f"unsupported.{metric}", status.alias("status"))
        out = gate if out is None else out.unionByName(gate)
    return out


def running_gates(measured: DataFrame, bounds: Bounds) -> DataFrame:
    """Time, cost, failures, and costs that nobody knows; percentiles by nearest rank."""
    measures = measured.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value")) for n, c in (("elapsed", "elapsed_ms"), ("cost", "known_usd"))])).alias("m")).select("m.*")
    row = percentiles(measures, "measure", "value").agg(*[F.max(F.when(F.col("measure") == n, F.col("p95"))).alias(n) for n in ("elapsed", "cost")])
    row = materialise(row.join(measured.agg(F.count_if("failed").alias("failed"), F.sum("unknown_attempts").alias("unknown"))), "running")
    sure = F.lit(False)
    gates = (
        ("processLatencyP95", F.col("elapsed") <= bounds.elapsed_p95, F.col("elapsed").isNull()),
        ("requestCostP95", F.col("cost") <= bounds.cost_p95, (F.col("unknown") > 0) | F.col("cost").isNull()),
        ("failedQueries", F.col("failed") <= bounds.failures, sure),
        ("unknownCosts", F.col("unknown") <= bounds.unknown_costs, sure),
    )
    out = None
    for name, passes, unknown in gates:
        own = _gate(row, name, _status(passes, unknown))
        out = own if out is None else out.unionByName(own)
    return out


def _together(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in tables.items():
        own = rows.select(F.lit(name).alias("cohort"), "*")
        out = own if out is None else out.unionByName(own)
    return out


@dataclass
class Report:
    """Tables of an evaluation, each with the ``cohort`` or ``proposal`` it is about."""

    measured: DataFrame
    summary: DataFrame
    comparisons: DataFrame
    gates: DataFrame
    decisions: DataFrame


def evaluate(questions: DataFrame, review: Review, captures: DataFrame, excerpts: DataFrame, cohorts: dict[str, tuple[str, Column]], baseline: str, proposals: tuple[str, ...], bounds: Bounds) -> Report:
    """Evaluate cohorts of ``captures`` and decide on each proposal.

    ``captures``: capture, question, system, phase, kind, failed, elapsed_ms, known_usd,
    unknown_attempts; ``excerpts``: capture, rank, source, text, start, end. A cohort is a system
    and a condition on its captures, of which it has one for each question. A proposal is
    compared with every comparator that ``bounds.deltas`` names. Questions, captures and reviews
    are sets of bounded size, so a cohort is scored after another.
    """
    chosen = materialise(select_cohorts(captures, cohorts), "cohorts")
    measured: dict[str, DataFrame] = {}
    means: dict[str, DataFrame] = {}
    summaries: dict[str, DataFrame] = {}
    for name in cohorts:
        own = chosen.where(F.col("cohort") == name)
        shown = excerpts.join(own.select("capture", "question"), "capture")
        measured[name] = materialise(measure(questions, review, own, shown), "measured")
        means[name] = materialise(question_means(questions, measured[name], 1), "means")
        summaries[name] = materialise(summarise_questions(questions, means[name]), "summary")
    compared, gates = materialise(compare_cohorts(questions, _together(means), proposals, bounds), "comparisons"), None
    for proposal in proposals:
        checked = quality_gates(compared.where(F.col("proposal") == proposal), bounds).unionByName(slice_gate(summaries[proposal], summaries[baseline], bounds))
        checked = checked.unionByName(harm_gates(questions, measured[proposal], measured[baseline], bounds)).unionByName(running_gates(measured[proposal], bounds))
        checked = checked.select(F.lit(proposal).alias("proposal"), "gate", "status")
        gates = checked if gates is None else gates.unionByName(checked)
    gates = materialise(gates, "gates")
    decisions = gates.groupBy("proposal").agg(F.when(F.every(F.col("status") == "PASS"), "GATES_PASS").otherwise("NO_ROLLOUT").alias("decision"))

    return Report(_together(measured), _together(summaries), compared, gates, decisions)


def coordinate_violations(excerpts: DataFrame, resolutions: DataFrame, sources: DataFrame) -> DataFrame:
    """``rule, capture, rank`` of displayed excerpts whose place is in doubt.

    ``excerpts``: capture, rank, source, text, start, end; ``resolutions``: capture, rank, line;
    ``sources``: source, text. A text that its source has more than once needs a resolution, and
    just one of its places must begin on the resolution's line, the one that was taken.
    """
    # all excerpts are looked for in one scan of the sources; then those of an excerpt's own source count
    spots = places(excerpts.select(F.col("text").alias("pattern")), sources.select(F.col("source").alias("id"), "text"))
    lines = spots.join(sources.select(F.col("source").alias("id"), F.col("text").alias("body")), "id").select(F.col("id").alias("source"), F.col("pattern").alias("text"), F.col("start").alias("at"), line_of(F.col("body"), F.col("start")).alias("start_line"))
    spots = excerpts.select("capture", "rank", "source", "text", F.col("start").alias("taken")).join(lines, ["source", "text"])
    spots = materialise(spots.select("capture", "rank", "taken", F.col("at").alias("start"), "start_line"), "places")
    counted = spots.groupBy("capture", "rank", "taken").agg(F.count("*").alias("n"))
    keys = ["capture", "rank"]
    unbound = counted.where("n > 1").join(resolutions, keys, "left_anti")
    fits = spots.join(resolutions, keys).groupBy(*keys, "taken").agg(F.count("*").alias("n"), F.count_if(F.col("start_line") == F.col("line")).alias("fits"), F.count_if((F.col("start_line") == F.col("line")) & (F.col("start") == F.col("taken"))).alias("right"))
    stray = resolutions.join(counted, keys, "left_anti")
    return (
        unbound.select(F.lit("repeated text without resolution").alias("rule"), *keys)
        .unionByName(fits.where("n < 2 OR fits <> 1 OR right <> 1").select(F.lit("ambiguous place").alias("rule"), *keys))
        .unionByName(stray.select(F.lit("resolution without excerpt").alias("rule"), *keys))
    )


def same_protocol(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``key`` of every setting in which runs (one row each) differ; runs are compared only if none does."""
    out = None
    for key in keys:
        own = runs.agg(F.countDistinct(F.coalesce(F.col(key).cast("string"), F.lit("\0"))).alias("n")).where("n > 1").select(F.lit(key).alias("key"))
        out = own if out is None else out.unionByName(own)
    return out


__all__ = ["Bounds", "METRICS", "Report", "Review", "compare_cohorts", "coordinate_violations", "evaluate", "harm_gates", "measure", "quality_gates", "running_gates", "same_protocol", "slice_gate"]
