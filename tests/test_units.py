"""Settings, run units, and the rules of captures and adjudications."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.errors import EngineError
from gleaner.operators.judgments import adjudication_violations, capture_violations
from gleaner.plans import runs
from gleaner.plans.runs import run_unit
from gleaner.sources.config import Config, parse_config, read_config
from gleaner.sources.markdown import scan_tree


def test_settings(spark, tmp_path):
    (tmp_path / ".agent").mkdir()
    with pytest.raises(EngineError, match="CONFIG_INVALID"):
        read_config(spark, str(tmp_path))
    (tmp_path / ".agent" / "memory.json").write_text('{"project": "p q", "embedding": {"model": "m", "more": 1}, "more": []}')
    assert read_config(spark, str(tmp_path)) == Config("p q", "m")
    assert parse_config('{"project": "p", "embedding": {"model": "m"}, "retrieval": {"model": "r"}}').retrieval == "r"


@pytest.mark.parametrize(
    "text",
    ["", "[]", "{}", '{"project": " ", "embedding": {"model": "m"}}', '{"project": "p"}', '{"project": "p", "embedding": "m"}', '{"project": "a\\nb", "embedding": {"model": "m"}}',
     '{"project": "p", "embedding": {"model": "\\ud800"}}', '{"project": "p", "embedding": {"model": "m"}, "retrieval": null}'],
)
def test_odd_settings(text):
    with pytest.raises(EngineError, match="CONFIG_INVALID"):
        parse_config(text)


def test_symbolic_links_among_sources_are_refused(spark, tmp_path):
    folder = tmp_path / ".agent" / "knowledge" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# A")
    assert scan_tree(spark, str(tmp_path)).count() == 1
    (folder / "node_modules").mkdir()
    os.symlink(folder / "a.md", folder / "node_modules" / "b.md")  # left out, so not looked at
    assert scan_tree(spark, str(tmp_path)).count() == 1
    os.symlink(folder / "a.md", folder / "b.md")
    with pytest.raises(EngineError, match="SOURCE_INVALID"):
        scan_tree(spark, str(tmp_path))


def test_a_unit_is_made_once(spark, tmp_path):
    made = []

    def compute(identity):
        made.append(identity)
        return spark.range(3)

    root, inputs = str(tmp_path / "runs"), {"b": 1, "a": ["ü"]}
    assert run_unit(spark, root, inputs, "u-1", compute).count() == 3
    assert run_unit(spark, root, {"a": ["ü"], "b": 1}, "u-1", compute).count() == 3
    assert made == [runs.identity_of(inputs)]
    run_unit(spark, root, inputs, "u-2", compute)
    run_unit(spark, root, {"a": []}, "u-1", compute)
    assert len(made) == 3
    with pytest.raises(EngineError, match="ARGUMENT_INVALID"):
        run_unit(spark, root, inputs, "../x", compute)


def test_a_failed_unit_is_made_again_and_a_claimed_one_is_not(spark, tmp_path):
    root = str(tmp_path / "runs")

    def fails(identity):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_unit(spark, root, 1, "u", fails)
    assert run_unit(spark, root, 1, "u", lambda identity: spark.range(2)).count() == 2

    def second(identity):
        with pytest.raises(EngineError, match="INDEX_BUSY"):
            run_unit(spark, root, 1, "v", fails)
        return spark.range(1)

    assert run_unit(spark, root, 1, "v", second).count() == 1
    at = f"{root}/{runs.identity_of(1)}/w/log"
    spark.createDataFrame([("claim", "dead", 0, None)], runs.LOG).write.parquet(at)  # a runner that died long ago
    assert run_unit(spark, root, 1, "w", lambda identity: spark.range(1)).count() == 1


def rules(found):
    return sorted((r["rule"], r["subject"]) for r in found.collect())


def test_rules_of_captures(spark):
    questions = spark.createDataFrame([("a",), ("b",)], "question string")
    good = [(q, s, "original-heldout", "actual") for q in "ab" for s in ("baseline", "qmd", "proposal")]
    frame = lambda rows: spark.createDataFrame(rows, "question string, system string, phase string, kind string")
    assert rules(capture_violations(questions, frame(good))) == []
    skipped = [(*r[:3], "evaluator-skip") if r[:2] == ("a", "proposal") else r for r in good]
    assert rules(capture_violations(questions, frame(skipped))) == [("skip without supplement", "a")]
    assert rules(capture_violations(questions, frame([*skipped, ("a", "proposal", "supplemental-heldout", "actual")]))) == []
    odd = [*good[1:], good[2], ("b", "proposal", "supplemental-heldout", "actual"), ("c", "qmd", "original-heldout", "actual")]
    assert rules(capture_violations(questions, frame(odd))) == [("capture repeated", "a"), ("original capture missing", "a"), ("question unknown", "c"), ("supplement without skip", "b")]


def test_rules_of_adjudications(spark):
    questions = spark.createDataFrame([("a", "p", "why", "x"), ("b", "p", None, "y")], "question string, project string, text string, reason string")
    evidence = spark.createDataFrame([("a", "e1", 0, 4)], "question string, id string, start int, end int")
    sources = spark.createDataFrame([("p", "s", "some text")], "project string, source string, text string")
    mapped = lambda *rows: spark.createDataFrame(rows, "question string, source string, text string, start int, end int, misleading boolean, reason string")
    good = mapped(("a", "s", "text", 5, 9, None, "ok"), ("b", "s", "gone", None, None, True, "nowhere"))
    more = evidence.unionByName(spark.createDataFrame([("b", "e2", 1, 2)], evidence.schema))
    assert rules(adjudication_violations(questions, evidence, questions.withColumn("reason", F.lit("new")), more, good, sources)) == []
    changed = questions.withColumn("text", F.lit("how"))
    assert rules(adjudication_violations(questions, evidence, changed, more, good, sources)) == [("question changed", "a"), ("question changed", "b")]
    assert rules(adjudication_violations(questions, evidence, questions, evidence.withColumn("end", F.lit(5)), good, sources)) == [("evidence changed", "a")]
    bad = mapped(("a", "s", "text", 4, 8, None, "ok"), ("a", "s", "text", 5, 9, None, "ok"), ("b", "t", "x", 0, 1, None, "ok"), ("c", "s", "x", None, None, None, " "), ("b", "s", "some", 0, None, None, "ok"))
    want = [("mapping is not its span", "a"), ("mapping is not its span", "b"), ("mapping of an unknown question", "c"), ("mapping of an unknown source", "b"), ("mapping repeated", "a"), ("mapping without text or reason", "c")]
    assert rules(adjudication_violations(questions, evidence, questions, evidence, bad, sources)) == want
