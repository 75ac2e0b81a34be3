import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import judgments as J
from gleaner.operators.batching import batch_inputs

Q = "question string, project string, text string, family string, slice string, split string, answerable boolean, facets array<string>"
E = "question string, evidence_id string, source string, start long, end long, grade int, facets array<string>"
X = "question string, repetition int, rank long, source string, text string, start long, end long, mapping string, misleading boolean"
O = "question string, repetition int, failed boolean"  # noqa: E741
G = {0: 0.0, 1: 1.0, 2: 3.0}


def dcg(values):
    return sum(v / math.log2(k + 2) for k, v in enumerate(values[:8]))


def plain(q, evidence, excerpts, failed):
    """One observation, rank by rank."""
    answerable, facets = q
    seen, found, unresolved, grades = set(), set(), False, []
    for r in [] if failed else excerpts[:8]:
        inside = [e for e in evidence if r["mapping"] == "exact" and e["source"] == r["source"] and r["start"] <= e["start"] and r["end"] >= e["end"]]
        unresolved |= not inside
        grades.append(max([e["grade"] for e in inside if e["id"] not in seen], default=0))
        for e in inside:
            if e["grade"]:
                seen.add(e["id"])
                found.update(e["facets"])
    known = answerable and not unresolved
    ideal = dcg(sorted((G[e["grade"]] for e in evidence), reverse=True))
    positive = sum(e["grade"] > 0 for e in evidence)
    absent = not answerable and not failed
    return {
        "unresolved": unresolved,
        **{f"useful{k}": int(2 in grades[:k]) if known else None for k in (1, 3, 5, 8)},
        "supporting": int(any(grades)) if known else None,
        "ndcg8": round(dcg([G[g] for g in grades]) / ideal if ideal else 0, 6) if known else None,
        "facet_recall8": round(len(found) / len(facets), 6) if known and facets else None,
        "span_recall8": round(len(seen) / positive, 6) if known and positive else None,
        "nonempty": int(bool(excerpts)) if absent else None,
        "misleading": (1 if any(e["misleading"] for e in excerpts) else None if any(e["misleading"] is None for e in excerpts) else 0) if absent else None,
    }


def test_observations_against_the_sequential_form(spark):
    rnd = random.Random(1)
    qs, es, os_, xs, want = [], [], [], [], {}
    for n in range(80):
        q, answerable, facets = f"q{n}", rnd.random() < 0.7, [f"f{k}" for k in range(rnd.randint(0, 3))]
        evidence = [{"id": f"e{k}", "source": rnd.choice("ab"), "start": (s := rnd.randint(0, 50)), "end": s + rnd.randint(1, 5), "grade": rnd.randint(0, 2) if answerable else 0, "facets": [f for f in facets if rnd.random() < 0.5]} for k in range(rnd.randint(0, 5))]
        qs.append((q, "p", "t", "f", "s", "x", answerable, facets))
        es += [(q, e["id"], e["source"], e["start"], e["end"], e["grade"], e["facets"]) for e in evidence]
        for rep in range(2):
            failed = rnd.random() < 0.15
            excerpts = []
            for k in range(rnd.randint(0, 10)):
                near = rnd.choice(evidence) if evidence and rnd.random() < 0.9 else {"source": "a", "start": 70, "end": 75}
                exact = rnd.random() < 0.95
                excerpts.append({"source": near["source"], "start": near["start"] - rnd.randint(0, 8) if exact else None, "end": near["end"] + rnd.randint(0, 8) if exact else None, "mapping": "exact" if exact else "adjudication", "misleading": rnd.choice([False, False, False, True, None])})
            os_.append((q, rep, failed))
            xs += [(q, rep, k + 1, e["source"], "t", e["start"], e["end"], e["mapping"], e["misleading"]) for k, e in enumerate(excerpts)]
            want[q, rep] = plain((answerable, facets), evidence, [] if failed else excerpts, failed)
    found = J.score_observations(spark.createDataFrame(qs, Q), spark.createDataFrame(es, E), spark.createDataFrame(os_, O), spark.createDataFrame(xs, X)).collect()
    assert len(found) == len(want)
    for r in found:
        assert {k: r[k] for k in want[r["question"], r["repetition"]]} == pytest.approx(want[r["question"], r["repetition"]], abs=2e-6), r


def renderings(spark, order, extra=()):
    at = "question string, source string, text string, start long, end long"
    shown = [("q", "s", "short", 0, 5, 1, ["a"], False), ("q", "s", "whole", 0, 9, 2, ["a"], False)]
    credit = [("q", "s", "short", 0, 5, "gc", 1), ("q", "s", "whole", 0, 9, "gc", 2)]
    excerpts = [("q", 0, k + 1, *(("s", "short", 0, 5) if x == "short" else ("s", "whole", 0, 9) if x == "whole" else ("s", "unknown", 1, 2)), "exact", None) for k, x in enumerate(order)]
    units = spark.createDataFrame([("q", "gc", 2), *extra], "question string, unit_id string, target_grade int")
    return J.score_renderings(
        spark.createDataFrame([("q", "p", "t", "f", "s", "x", True, ["a", "b"])], Q),
        units,
        spark.createDataFrame(shown, f"{at}, display_grade int, facets array<string>, misleading boolean"),
        spark.createDataFrame(credit, f"{at}, unit_id string, achieved_grade int"),
        spark.createDataFrame([("q", 0, False)], O),
        spark.createDataFrame(excerpts, X),
    ).first()


def test_renderings(spark):
    r = renderings(spark, ["whole", "whole"], [("q", "other", 2)])
    assert (r["ndcg8"], r["span_recall8"], r["facet_recall8"], r["useful1"]) == (round(3 / (3 + 3 / math.log2(3)), 6), 0.5, 0.5, 1)
    r = renderings(spark, ["short", "whole"])
    assert (r["ndcg8"], r["span_recall8"], r["useful1"], r["useful3"]) == (round((1 + 2 / math.log2(3)) / 3, 6), 1.0, 0, 1)
    r = renderings(spark, ["whole", "unknown"])
    assert r["unresolved"] and r["ndcg8"] is None and r["useful1"] is None
    r = renderings(spark, [])
    assert (r["ndcg8"], r["span_recall8"], r["supporting"]) == (0, 0, 0)


def test_saved_results(spark):
    sources = spark.createDataFrame([(".agent/knowledge/a b.md", "x" * 10 + "unique" + "y" * 400 + "twice twice"), (".agent/knowledge/dots.md", "z" * 297 + "... and more")], "source string, text string")
    raw = json.dumps({"results": [{"source": ".agent/knowledge/a b.md", "snippet": "unique"}, {"source": ".agent/knowledge/a b.md", "snippet": "y" * 400 + "…"}, {"source": "none.md", "snippet": "twice"}] + [{"source": "s", "snippet": "n"}] * 9})
    found = J.prefix_results(spark.createDataFrame([("q", raw)], "question string, raw string"))
    assert found.count() == 8 and found.where("rank = 2").first()["text"] == "y" * 400
    placed = {r["rank"]: (r["start"], r["end"], r["mapping"]) for r in J.map_excerpts(found, sources).collect()}
    assert placed[1] == (10, 16, "exact") and placed[2] == (16, 416, "exact") and placed[3] == (None, None, "adjudication")
    raw = json.dumps([{"file": "notes://p/a%20b.md", "snippet": "@@ -1,2 @@ (x)\nunique"}, {"file": "notes://p/dots.md?index=p", "snippet": "z" * 297 + "..."}, {"file": "notes://p/a%20b.md", "snippet": "😀" + "y" * 295 + "..."}])
    rows = {r["rank"]: r for r in J.url_results(spark.createDataFrame([("q", "p", raw)], "question string, project string, raw string"), sources, "notes").collect()}
    assert rows[1]["source"] == ".agent/knowledge/a b.md" and rows[1]["text"] == "unique"
    assert rows[2]["text"].endswith("...") and rows[3]["text"] == "😀" + "y" * 295
    other = spark.createDataFrame([("q", "other", raw)], "question string, project string, raw string")
    with pytest.raises(Exception):
        J.url_results(other, sources, "notes").collect()
    decided = J.adjudicate(J.map_excerpts(found, sources), spark.createDataFrame([("q", 3, 416, 421)], "question string, rank long, start long, end long"), ["question", "rank"])
    assert decided.where("rank = 3").select("start", "end", "mapping").first() == (416, 421, "exact")


def test_occurrences(spark):
    rows = [("aaa\nbaa", "aa"), ("x.y\\E x.y\\E", "x.y\\E"), ("none", "zz"), ("😀a😀a", "a"), ("abc", "")]
    found = J.occurrences(spark.createDataFrame(rows, "body string, text string")).collect()
    got = sorted((r["body"], r["start"], r["end"], r["start_line"], r["start_column"]) for r in found)
    want = []
    for body, text in rows:
        at = body.find(text) if text else -1
        while at >= 0:
            want.append((body, at, at + len(text), body[:at].count("\n") + 1, at - (body[:at].rfind("\n") + 1) + 1))
            at = body.find(text, at + 1)
    assert got == sorted(want)


def test_summaries_and_harm(spark):
    qs = spark.createDataFrame([("a", "p", "t", "f", "s1", "x", True, ["f"]), ("b", "p", "t", "f", "s1", "x", True, []), ("c", "r", "t", "f", "s2", "x", False, [])], Q)
    null = dict.fromkeys(J.METRICS)
    rows = [("a", 0, False, {**null, "useful8": 1, "ndcg8": 0.5, "facet_recall8": 1.0}), ("b", 0, False, null), ("c", 0, False, {**null, "nonempty": 1, "misleading": None})]
    kinds = ", ".join(f"{m} double" for m in J.METRICS)
    measured = spark.createDataFrame([(q, r, f, *[None if m[k] is None else float(m[k]) for k in J.METRICS]) for q, r, f, m in rows], f"question string, repetition int, failed boolean, {kinds}")
    got = {(r["scope"], r["name"], r["metric"]): (r["mean"], r["scored"], r["eligible"], r["missing"]) for r in J.summarise_questions(qs, J.question_means(qs, measured, 1)).collect()}
    assert got["all", "", "useful8"] == (1.0, 1, 2, 1) and got["project", "p", "facet_recall8"] == (1.0, 1, 1, 0) and got["slice", "s2", "nonempty"] == (1.0, 1, 1, 0)
    assert ("slice", "s2", "useful8") not in got
    assert tuple(J.summarise_harm(qs, measured).first()) == (1, 1.0, 0, 1, None)


def test_cohorts_and_superiority(spark):
    rows = [("q1", "x", "original", "actual"), ("q1", "y", "original", "skip"), ("q1", "y", "later", "actual"), ("q2", "y", "original", "actual")]
    captures = spark.createDataFrame(rows, "question string, system string, phase string, kind string")
    found = J.select_cohorts(captures, {"x": ("x", F.col("phase") == "original"), "first": ("y", F.col("phase") == "original"), "real": ("y", F.col("kind") == "actual")})
    assert {(r["cohort"], r["question"], r["phase"]) for r in found.collect()} == {("x", "q1", "original"), ("first", "q1", "original"), ("first", "q2", "original"), ("real", "q1", "later"), ("real", "q2", "original")}
    outcome = spark.createDataFrame([(3, 0.2)], "questions long, mean_delta double")
    for low, missing, status in ((0.1, False, "PASS"), (-0.1, False, "FAIL"), (0.1, True, "INCONCLUSIVE"), (None, False, "INCONCLUSIVE")):
        interval = spark.createDataFrame([(low, 0.3)], "low double, high double")
        assert J.superiority(outcome, interval, F.lit(missing), 0.1, 0.0).first()["status"] == status


def labels():
    qs, es = [], []
    for (split, name), n in J.ALLOCATION.items():
        for k in range(n):
            q = f"{split}-{name}-{k}"
            answerable = name != "unanswerable"
            qs.append((q, "p", "t", q, name, split, answerable, ["f"] if answerable else []))
            es.append((q, "e", "s.md", 0, 3, 2 if answerable else 0, ["f"] if answerable else []))
    return qs, es


def test_label_rules(spark):
    qs, es = labels()
    sources = spark.createDataFrame([("p", "s.md", "text")], "project string, source string, text string")
    broken = lambda q, e: {r["rule"] for r in J.label_violations(spark.createDataFrame(q, Q), spark.createDataFrame(e, E), sources).collect()}
    assert broken(qs, es) == set()
    assert broken(qs[1:], es[1:]) == {"allocation"}
    assert broken([(*qs[0][:3], qs[-1][3], *qs[0][4:]), *qs[1:]], es) == {"family in both splits"}
    assert broken(qs, [(*es[0][:4], 99, *es[0][5:]), *es[1:]]) == {"evidence span"}
    assert broken(qs, [(*es[0][:5], 1, es[0][6]), *es[1:]]) == {"no direct evidence"}
    assert broken(qs, [(*es[0][:6], ["g"]), *es[1:]]) == {"facet unknown", "facet uncovered"}
    assert "evidence repeated" in broken(qs, [es[0], *es])


def test_rendering_rules(spark):
    at = "question string, source string, text string, start long, end long"
    sources = spark.createDataFrame([("s", "some text")], "source string, text string")
    units = spark.createDataFrame([("q", "u", "s", 0, 4, 2)], "question string, unit_id string, source string, start long, end long, target_grade int")

    def broken(shown, credit):
        r = spark.createDataFrame(shown, f"{at}, display_grade int, facets array<string>, misleading boolean")
        c = spark.createDataFrame(credit, f"{at}, unit_id string, achieved_grade int, quote_start long, quote_end long")
        return {x["rule"] for x in J.rendering_violations(units, r, c, sources).collect()}

    key = ("q", "s", "some", 0, 4)
    assert broken([(*key, 2, [], False)], [(*key, "u", 2, 0, 4)]) == set()
    assert broken([(*key, 2, [], False)], []) == {"grade without credit"}
    assert broken([(*key, 1, [], False)], [(*key, "u", 2, 0, 4)]) == {"credit too high", "grade without credit"}
    assert broken([(*key, 2, [], False)], [(*key, "u", 2, 5, 9)]) == {"credit misses its unit"}
    assert broken([("q", "s", "same", 0, 4, 0, [], False)], []) == {"text is not its span"}


def test_batches(spark):
    sizes = [10, 20, 30, 40, 100, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "id long, tokens long").coalesce(1)
    found = batch_inputs(df, 3, 100).orderBy("id").collect()
    assert [r["batch"] for r in found] == [0, 0, 0, 1, 2, 3, 3, 3, 4, 4]
    with pytest.raises(Exception):
        batch_inputs(df, 3, 99).collect()
