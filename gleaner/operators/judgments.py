"""Judged retrieval: saved results to excerpts, excerpts to metrics, metrics to summaries.

Unknown is null and never zero: an observation with an unresolved excerpt has no quality metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import column_of, line_of
from gleaner.operators.metrics import DEPTH, gain

#: How saved results are clipped, and questions for each split and slice.
PREFIX_CLIP, URL_CLIP = 400, 300
LOCATION = r"^@@ -\d+,\d+ @@[^\n]*\n"
ALLOCATION = {
    ("development", "paraphrase"): 8, ("held-out", "paraphrase"): 12,
    ("development", "identifiers"): 6, ("held-out", "identifiers"): 9,
    ("development", "ambiguous"): 4, ("held-out", "ambiguous"): 6,
    ("development", "suffix"): 4, ("held-out", "suffix"): 6,
    ("development", "facets"): 4, ("held-out", "facets"): 6,
    ("development", "unanswerable"): 4, ("held-out", "unanswerable"): 11,
}


# Saved results


def prefix_results(captures: DataFrame) -> DataFrame:
    """``question, rank, source, text`` of saved JSON ``{"results": [{source, snippet}]}``.

    A snippet of just 401 characters that ends in an ellipsis was clipped to 400.
    """
    parsed = F.from_json("raw", "results array<struct<source:string,snippet:string>>")
    rows = captures.select("question", F.posexplode(parsed["results"]).alias("at", "r")).where(F.col("at") < DEPTH)
    text = F.col("r.snippet")
    clipped = (F.length(text) == PREFIX_CLIP + 1) & text.endswith("…")
    return rows.select("question", (F.col("at") + 1).cast("long").alias("rank"), F.col("r.source").alias("source"), F.when(clipped, F.substring(text, 1, PREFIX_CLIP)).otherwise(text).alias("text"))


def url_results(captures: DataFrame, sources: DataFrame, scheme: str, folder: str = ".agent/knowledge/") -> DataFrame:
    """``question, rank, source, text`` of saved JSON ``[{file, snippet}]`` whose files are URLs.

    A location header before a snippet is not source. A snippet of 300 UTF-16 units that ends in
    three periods was clipped, unless the source has it as it stands. A file of another collection
    than the question's ``project`` is an error.
    """
    parsed = F.from_json("raw", "array<struct<file:string,snippet:string>>")
    rows = captures.select("question", "project", F.posexplode(parsed).alias("at", "r")).where(F.col("at") < DEPTH)
    prefix = F.concat(F.lit(f"{scheme}://"), F.col("project"), F.lit("/"))
    path = F.when(F.startswith(F.col("r.file"), prefix), F.regexp_replace(F.substring(F.col("r.file"), F.length(prefix) + 1, F.length("r.file")), r"\?.*$", "")).otherwise(F.raise_error(F.lit("a result of another collection")))
    text = F.regexp_replace("r.snippet", LOCATION, "")
    rows = rows.select("question", (F.col("at") + 1).cast("long").alias("rank"), F.concat(F.lit(folder), F.url_decode(F.regexp_replace(path, r"\+", "%2B"))).alias("source"), text.alias("text"))
    joined = rows.join(sources.select("source", F.col("text").alias("body")), "source", "left")
    units = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    clipped = (units == URL_CLIP) & F.col("text").endswith("...") & ~F.coalesce(F.contains("body", "text"), F.lit(False))
    return joined.select("question", "rank", "source", F.when(clipped, F.substring(F.col("text"), F.lit(1), F.length("text") - 3)).otherwise(F.col("text")).alias("text"))


def map_excerpts(excerpts: DataFrame, sources: DataFrame) -> DataFrame:
    """``excerpts`` with ``start, end, mapping``: their places if the source has the text just once.

    ``mapping`` is ``exact`` or ``adjudication``; the latter has no place.
    """
    joined = excerpts.join(sources.select("source", F.col("text").alias("body")), "source", "left")
    at = F.expr("locate(text, body)")
    once = F.coalesce((F.length("text") > 0) & (at > 0) & (F.expr("locate(text, body, locate(text, body) + 1)") == 0), F.lit(False))
    start = F.when(once, (at - 1).cast("long"))
    return joined.select(*excerpts.columns, start.alias("start"), (start + F.length("text")).cast("long").alias("end"), F.when(once, "exact").otherwise("adjudication").alias("mapping"))


def adjudicate(mapped: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Mapped excerpts with the places that reviewers decided on, where there are any."""
    decided = decisions.select(*keys, F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    joined = mapped.join(decided, keys, "left")
    known = F.col("d_start").isNotNull()
    return joined.select(*[c for c in mapped.columns if c not in ("start", "end", "mapping")], F.coalesce("start", "d_start").alias("start"), F.coalesce("end", "d_end").alias("end"), F.when(known, "exact").otherwise(F.col("mapping")).alias("mapping"))


def occurrences(rows: DataFrame) -> DataFrame:
    """All places of ``text`` in ``body``, overlapping ones too: ``rows`` with ``start, end, start_line, start_column``.

    The body is split before every place, so places are sums of lengths.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(F.col("text"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    starts = F.aggregate(F.split(F.col("body"), quoted), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    real = F.filter(starts, lambda s: F.substring(F.col("body"), s + 1, F.length("text")) == F.col("text"))
    found = rows.where(F.length("text") > 0).withColumn("start", F.explode(real)).withColumn("start", F.col("start").cast("long"))
    return found.withColumn("end", F.col("start") + F.length("text")).withColumn("start_line", line_of(F.col("body"), F.col("start"))).withColumn("start_column", column_of(F.col("body"), F.col("start")))


# Metrics of observations

_KEY = ["question", "repetition"]


def _dcg(value: Column, rank: Column) -> Column:
    return F.sum(F.when(rank <= DEPTH, value / F.log2(rank + 1)))


def _finish(observations: DataFrame, questions: DataFrame, ideal: DataFrame, got: DataFrame, shown: DataFrame) -> DataFrame:
    """Metrics of each observation from what its results earned, by the rules for unknown ones."""
    joined = observations.join(questions.select("question", "answerable", "facets"), "question").join(ideal, "question", "left").join(got, _KEY, "left").join(shown, _KEY, "left")
    unresolved = F.coalesce("unresolved", F.lit(False)) & ~F.col("failed")
    known = F.col("answerable") & ~unresolved
    zero = lambda c: F.coalesce(c, F.lit(0))
    absent = ~F.col("answerable") & ~F.col("failed")
    return joined.select(
        *_KEY,
        "failed",
        unresolved.alias("unresolved"),
        *[F.when(known, zero(f"useful{k}")).alias(f"useful{k}") for k in (1, 3, 5, 8)],
        F.when(known, zero("supporting")).alias("supporting"),
        F.when(known, F.round(F.when(F.col("ideal") > 0, zero("dcg") / F.col("ideal")).otherwise(0.0), 6)).alias("ndcg8"),
        F.when(known & (F.size("facets") > 0), F.round(zero("facets_seen") / F.size("facets"), 6)).alias("facet_recall8"),
        F.when(known & (F.col("total") > 0), F.round(zero("spans") / F.col("total"), 6)).alias("span_recall8"),
        F.when(absent, (zero("n") > 0).cast("int")).alias("nonempty"),
        F.when(absent, F.when(zero("misleading") > 0, 1).when(F.coalesce("misleading_unknown", F.lit(False)), None).otherwise(0)).alias("misleading"),
    )


def score_observations(questions: DataFrame, evidence: DataFrame, observations: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Metrics by evidence that excerpts contain.

    ``questions``: question, answerable, facets. ``evidence``: question, evidence_id, source, start,
    end, grade, facets. ``observations``: question, repetition, failed. ``excerpts``: question,
    repetition, rank, source, start, end, mapping, misleading (null: unknown). An excerpt without
    place, or that contains no evidence, leaves the observation unresolved. Evidence counts once,
    at the first rank that contains it. A failed observation has no excerpts.
    """
    alive = excerpts.join(observations.where(~F.col("failed")).select(*_KEY), _KEY)
    top = alive.where(F.col("rank") <= DEPTH)
    e = evidence.select("question", "evidence_id", "source", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "grade", F.col("facets").alias("e_facets"))
    placed = top.where("mapping = 'exact'").join(e, ["question", "source"]).where("start <= e_start AND end >= e_end")
    solved = placed.select(*_KEY, "rank").distinct().withColumn("solved", F.lit(True))
    shown = top.join(solved, [*_KEY, "rank"], "left").groupBy(*_KEY).agg(F.max(F.col("solved").isNull()).alias("unresolved"))
    everything = alive.groupBy(*_KEY).agg(F.count("*").alias("n"), F.count_if(F.col("misleading")).alias("misleading"), F.max(F.col("misleading").isNull()).alias("misleading_unknown"))
    shown = everything.join(shown, _KEY, "left")
    # grade 0 evidence never becomes seen, and adds nothing
    first = placed.where("grade > 0").groupBy(*_KEY, "evidence_id").agg(F.min("rank").alias("rank"), F.first("grade").alias("grade"))
    by_rank = first.groupBy(*_KEY, "rank").agg(F.max("grade").alias("grade"), F.count("*").alias("spans"))
    useful = [F.max(((F.col("grade") == 2) & (F.col("rank") <= k)).cast("int")).alias(f"useful{k}") for k in (1, 3, 5, 8)]
    got = by_rank.groupBy(*_KEY).agg(*useful, F.lit(1).alias("supporting"), _dcg(gain(F.col("grade")), F.col("rank")).alias("dcg"), F.sum("spans").alias("spans"))
    facets = placed.where("grade > 0").select(*_KEY, F.explode("e_facets").alias("f")).distinct().groupBy(*_KEY).agg(F.count("*").alias("facets_seen"))
    return _finish(observations, questions, _ideal(evidence, "evidence_id", "grade"), got.join(facets, _KEY, "left"), shown)


def _ideal(targets: DataFrame, name: str, grade: str) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.col(grade).desc(), name)
    ranked = targets.where(F.col(grade) > 0).withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("question").agg(_dcg(gain(F.col(grade)), F.col("rank")).alias("ideal"), F.count("*").alias("total"))


def score_renderings(questions: DataFrame, units: DataFrame, renderings: DataFrame, credits: DataFrame, observations: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Metrics by reviewed renderings: what a shown text is worth was decided on beforehand.

    ``units``: question, unit_id, target_grade. ``renderings``: question, source, text, start, end,
    display_grade, facets, misleading. ``credits``: the same keys, unit_id, achieved_grade. An
    excerpt without rendering leaves the observation unresolved. A rank gains the largest
    improvement of any unit over all earlier ranks.
    """
    at = ["question", "source", "text", "start", "end"]
    alive = excerpts.join(observations.where(~F.col("failed")).select(*_KEY), _KEY)
    top = alive.where(F.col("rank") <= DEPTH).select(*_KEY, "rank", *at[1:])
    read = top.join(renderings.select(*at, "display_grade", F.col("facets").alias("r_facets"), F.col("misleading").alias("r_misleading")), at, "left")
    unknown = F.col("display_grade").isNull()
    counted = alive.groupBy(*_KEY).agg(F.count("*").alias("n"))
    useful = [F.max(F.coalesce((F.col("display_grade") == 2) & (F.col("rank") <= k), F.lit(False)).cast("int")).alias(f"useful{k}") for k in (1, 3, 5, 8)]
    shown = read.groupBy(*_KEY).agg(F.max(unknown).alias("unresolved"), F.max(unknown).alias("misleading_unknown"), F.count_if(F.col("r_misleading")).alias("misleading"))
    shown = counted.join(shown, _KEY, "left")
    graded = read.groupBy(*_KEY).agg(*useful, F.max(F.coalesce(F.col("display_grade") > 0, F.lit(False)).cast("int")).alias("supporting"))
    facets = read.select(*_KEY, F.explode("r_facets").alias("f")).distinct().groupBy(*_KEY).agg(F.count("*").alias("facets_seen"))
    earned = top.join(credits, at).groupBy(*_KEY, "unit_id", "rank").agg(F.max(gain(F.col("achieved_grade"))).alias("gain"))
    earlier = Window.partitionBy(*_KEY, "unit_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    fresh = earned.withColumn("fresh", F.greatest(F.lit(0.0), F.col("gain") - F.coalesce(F.max("gain").over(earlier), F.lit(0.0))))
    dcg = fresh.groupBy(*_KEY, "rank").agg(F.max("fresh").alias("fresh")).groupBy(*_KEY).agg(_dcg(F.col("fresh"), F.col("rank")).alias("dcg"))
    best = earned.groupBy(*_KEY, "unit_id").agg(F.max("gain").alias("best"))
    spans = best.join(units, ["question", "unit_id"]).where(F.col("best") >= gain(F.col("target_grade"))).groupBy(*_KEY).agg(F.count("*").alias("spans"))
    got = graded.join(facets, _KEY, "left").join(dcg, _KEY, "left").join(spans, _KEY, "left")
    return _finish(observations, questions, _ideal(units, "unit_id", "target_grade"), got, shown)


# Summaries

METRICS = ("useful1", "useful3", "useful5", "useful8", "supporting", "ndcg8", "facet_recall8", "span_recall8", "nonempty", "misleading")


def question_means(questions: DataFrame, measured: DataFrame, repetitions: int) -> DataFrame:
    """``question, metric, mean``: null unless every repetition is there and known."""
    pairs = ", ".join(f"'{m}', cast(`{m}` AS double)" for m in METRICS)
    long = measured.selectExpr("question", "repetition", f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
    found = long.groupBy("question", "metric").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.avg("value").alias("mean"))
    every = questions.select("question").withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    whole = (F.col("n") == repetitions) & (F.col("known") == repetitions)
    return every.join(found, ["question", "metric"], "left").select("question", "metric", F.when(whole, F.col("mean")).alias("mean"))


def summarise_questions(questions: DataFrame, means: DataFrame) -> DataFrame:
    """Overall, by project and by slice: ``scope, name, metric, mean, scored, eligible, missing``.

    Harm metrics are for unanswerable questions, the others for answerable ones, facet recall
    for those with facets.
    """
    q = questions.select("question", "project", "slice", "answerable", "facets")
    harm = F.col("metric").isin("nonempty", "misleading")
    fits = F.when(harm, ~F.col("answerable")).otherwise(F.col("answerable") & ((F.col("metric") != "facet_recall8") | (F.size("facets") > 0)))
    rows = means.join(q, "question").where(fits)
    sql = """
    SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(slice) = 0 THEN 'slice' ELSE 'all' END AS scope,
           CASE WHEN grouping(project) = 0 THEN project WHEN grouping(slice) = 0 THEN slice ELSE '' END AS name,
           metric, round(avg(mean), 6) AS mean, count(mean) AS scored, count(*) AS eligible, count(*) - count(mean) AS missing
    FROM {rows} GROUP BY GROUPING SETS ((metric), (project, metric), (slice, metric))
    """
    return rows.sparkSession.sql(sql, rows=rows)


def summarise_harm(questions: DataFrame, measured: DataFrame) -> DataFrame:
    """One row on unanswerable questions that didn't fail: how many showed something, or misled."""
    rows = measured.join(questions.where(~F.col("answerable")).select("question"), "question").where(~F.col("failed"))
    return rows.agg(
        F.count("*").alias("successes"),
        F.round(F.avg("nonempty"), 6).alias("nonempty_rate"),
        F.count("misleading").alias("judged"),
        (F.count("*") - F.count("misleading")).alias("unknown"),
        F.round(F.avg("misleading"), 6).alias("misleading_rate"),
    )


def select_cohorts(captures: DataFrame, cohorts: dict[str, tuple[str, Column]]) -> DataFrame:
    """``cohort`` and the captures that belong to it: one of each question, by system and condition."""
    out = None
    for name, (system, condition) in cohorts.items():
        own = captures.where((F.col("system") == system) & condition).withColumn("cohort", F.lit(name))
        out = own if out is None else out.unionByName(own)
    first = F.row_number().over(Window.partitionBy("cohort", "question").orderBy("phase", "kind"))
    return out.withColumn("n", first).where("n = 1").drop("n")


def superiority(outcome: DataFrame, interval: DataFrame, missing: Column, margin: float, lower: float) -> DataFrame:
    """``status`` of a comparison: its mean delta and its interval's low end must reach their bounds."""
    holds = (F.col("mean_delta") >= margin) & (F.col("low") >= lower)
    unknown = missing | (F.col("questions") == 0) | F.col("low").isNull()
    return outcome.crossJoin(F.broadcast(interval)).select(F.when(unknown, "INCONCLUSIVE").when(holds, "PASS").otherwise("FAIL").alias("status"))


# Checks: each gives the rows that break a rule, and none if all is well


def label_violations(questions: DataFrame, evidence: DataFrame, sources: DataFrame, complete: bool = True) -> DataFrame:
    """``rule, subject`` of every rule that labels break.

    ``questions``: question, project, text, family, slice, split, answerable, facets. ``evidence``: question,
    evidence_id, source, start, end, grade, facets. ``sources``: project, source, text.
    """
    q, e = questions, evidence.join(questions.select("question", "project", F.col("facets").alias("q_facets"), "answerable"), "question", "left")
    placed = e.join(sources.select("project", "source", F.length("text").alias("size")), ["project", "source"], "left")
    good = e.where("grade > 0").select("question", F.explode("facets").alias("f")).distinct()
    graded = evidence.groupBy("question").agg(F.max("grade").alias("best"))
    with_best = q.join(graded, "question", "left")
    slices = sorted({s for _, s in ALLOCATION})
    spark = q.sparkSession
    expected = spark.createDataFrame([(*k, n) for k, n in ALLOCATION.items() if complete or k[0] == "development"], "split string, slice string, expected long")
    counts = q.groupBy("split", "slice").agg(F.count("*").alias("n"))
    rules = {
        "question id": q.where(~F.coalesce(F.col("question").cast("string").rlike(r"^[a-zA-Z0-9_-]+$"), F.lit(False))).select("question"),
        "question repeated": q.groupBy("question").count().where("count > 1").select("question"),
        "slice": q.where(~F.col("slice").isin(*slices) | (F.col("answerable") == (F.col("slice") == "unanswerable"))).select("question"),
        "family in both splits": q.groupBy("family").agg(F.countDistinct("split").alias("n")).where("n > 1").select("family"),
        "project": q.join(sources.select("project").distinct(), "project", "left_anti").select("question"),
        "evidence span": placed.where(~F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("size")), F.lit(False))).select("evidence_id"),
        "evidence grade": e.where(~F.coalesce(F.col("grade").isin(0, 1, 2), F.lit(False))).select("evidence_id"),
        "evidence repeated": evidence.groupBy("question", "evidence_id").count().where("count > 1").select("evidence_id"),
        "span repeated": evidence.groupBy("question", "source", "start", "end").count().where("count > 1").select("question"),
        "facet unknown": e.where(F.size(F.array_except("facets", "q_facets")) > 0).select("evidence_id"),
        "facet uncovered": q.select("question", F.explode("facets").alias("f")).join(good, ["question", "f"], "left_anti").select("f"),
        "no direct evidence": with_best.where(F.col("answerable") & (F.coalesce("best", F.lit(0)) < 2)).select("question"),
        "evidence for the unanswerable": with_best.where(~F.col("answerable") & (F.coalesce("best", F.lit(0)) > 0)).select("question"),
        "allocation": expected.join(counts, ["split", "slice"], "left").where(F.coalesce("n", F.lit(0)) != F.col("expected")).select(F.concat_ws("/", "split", "slice").alias("s")),
    }
    out = None
    for rule, rows in rules.items():
        own = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out


def rendering_violations(units: DataFrame, renderings: DataFrame, credits: DataFrame, sources: DataFrame) -> DataFrame:
    """``rule, subject`` of every rule that reviewed renderings break.

    ``sources``: source, text. ``credits`` carry the keys of their rendering, ``unit_id, achieved_grade``,
    and the quoted span ``quote_start, quote_end``; ``units`` have source, start, end.
    """
    at = ["question", "source", "text", "start", "end"]
    body = sources.select("source", F.col("text").alias("body"))
    shown = renderings.join(body, "source", "left")
    unit = units.select("question", "unit_id", F.col("source").alias("u_source"), F.col("start").alias("u_start"), F.col("end").alias("u_end"), "target_grade")
    credited = credits.join(unit, ["question", "unit_id"], "left").join(renderings.select(*at, "display_grade"), at, "left")
    best = credits.groupBy(*at).agg(F.max("achieved_grade").alias("best"))
    meets = (F.col("u_start") < F.col("quote_end")) & (F.col("quote_start") < F.col("u_end")) & (F.col("u_source") == F.col("source"))
    bounded = (F.col("achieved_grade") <= F.col("target_grade")) & (F.col("achieved_grade") <= F.col("display_grade"))
    same = F.substring(F.col("body"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    rules = {
        "text is not its span": shown.where(~F.coalesce(same, F.lit(False))),
        "rendering repeated": renderings.groupBy(*at).count().where("count > 1"),
        "credit misses its unit": credited.where(~F.coalesce(meets, F.lit(False))),
        "credit too high": credited.where(~F.coalesce(bounded, F.lit(False))),
        "grade without credit": renderings.join(best, at, "left").where(F.coalesce("best", F.lit(0)) != F.col("display_grade")),
    }
    out = None
    for rule, rows in rules.items():
        own = rows.select(F.lit(rule).alias("rule"), F.col("question").cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out


def capture_violations(questions: DataFrame, captures: DataFrame, systems: tuple[str, ...] = ("baseline", "qmd", "proposal"), proposal: str = "proposal") -> DataFrame:
    """``rule, subject`` of every rule that the captures of ``questions`` (question) break.

    ``captures``: question, system, phase, kind. Every system has an original capture of every
    question; a question has a supplemental one just where the proposal's original was skipped.
    """
    original = captures.where("phase = 'original-heldout'")
    due = questions.select("question").distinct().withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    skipped = original.where((F.col("system") == proposal) & (F.col("kind") == "evaluator-skip")).select("question").distinct()
    more = captures.where("phase = 'supplemental-heldout'").select("question").distinct()
    rules = {
        "original capture missing": due.join(original.select("question", "system").distinct(), ["question", "system"], "left_anti"),
        "capture repeated": captures.groupBy("question", "system", "phase").count().where("count > 1"),
        "skip without supplement": skipped.join(more, "question", "left_anti"),
        "supplement without skip": more.join(skipped, "question", "left_anti"),
        "question unknown": captures.join(questions.select("question"), "question", "left_anti"),
    }
    return _named(rules)


def _named(rules: dict[str, DataFrame]) -> DataFrame:
    """``rule, subject`` of all rules, a question being the subject."""
    out = None
    for rule, rows in rules.items():
        own = rows.select(F.lit(rule).alias("rule"), F.col("question").cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out


def adjudication_violations(questions: DataFrame, evidence: DataFrame, revised: DataFrame, revised_evidence: DataFrame, mappings: DataFrame, sources: DataFrame) -> DataFrame:
    """``rule, subject`` of every rule that an adjudication breaks.

    A review may add evidence, but neither change questions nor evidence that was there: ``questions``
    and ``revised`` have the same columns but for ``reason``, as have ``evidence`` and
    ``revised_evidence``. ``mappings`` (question, source, text, start, end, misleading, reason) say where
    a displayed text stands in ``sources`` (project, source, text), or nowhere if both ends are null.
    """
    names = [c for c in questions.columns if c != "reason"]
    kept = [c for c in evidence.columns if c in revised_evidence.columns]
    told = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    was, now = (q.select("question", told(names).alias("contract")) for q in (questions, revised))
    had, has = (e.select("question", told(kept).alias("row")) for e in (evidence, revised_evidence))
    placed = mappings.join(revised.select("question", "project"), "question").join(sources.select("project", "source", F.col("text").alias("body")), ["project", "source"], "left")
    nowhere = F.col("start").isNull() & F.col("end").isNull()
    own = F.substring(F.col("body"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    whole = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("body")) & (own == F.col("text"))
    rules = {
        "question missing": was.join(now, "question", "left_anti"),
        "question added": now.join(was, "question", "left_anti"),
        "question changed": was.join(now.withColumnRenamed("contract", "other"), "question").where("contract <> other"),
        "evidence changed": had.join(has, ["question", "row"], "left_anti"),
        "mapping of an unknown question": mappings.join(revised.select("question"), "question", "left_anti"),
        "mapping without text or reason": mappings.where(~F.coalesce((F.length("text") > 0) & (F.length(F.trim("reason")) > 0), F.lit(False))),
        "mapping of an unknown source": placed.where(F.col("body").isNull()),
        "mapping is not its span": placed.where(F.col("body").isNotNull() & ~nowhere & ~F.coalesce(whole, F.lit(False))),
        "mapping repeated": mappings.groupBy("question", "source", "text").count().where("count > 1"),
    }
    return _named(rules)
