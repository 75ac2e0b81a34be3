import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm.queries import op3_toxicity
from gleaner.llm.toxicity import AGENT, END, GAP, HARM, INSULT, LINK, NEGATION, PARTS, QUOTE, REPORT, STATES, SYMBOLS, TABLE, TARGET, Grammar, Reader, Weights, clause_weights, fit, score_documents
from tests.llm.texts import awkward, frame

LEXICON = {"moron": 3.0, "scum": 2.0, "réeux*": 1.0}


def weight(text):
    symbols, _ = Reader(LEXICON).read(text.lower().split())
    return sum(clause_weights(itertools.chain.from_iterable(symbols)))


def test_the_parts_are_composed():
    insult, threat, target, negation, report = PARTS
    assert len(STATES) == insult.states * threat.states * target.states * negation.states * report.states
    assert all(len(row) == len(SYMBOLS) for row in TABLE)


@pytest.mark.parametrize(
    "text, want",
    [
        ("moron", 0.0),
        ("moron!", 0.0),
        ("moron moron scum", 0.0),
        ("today moron came", 0.0),
        ("what a moron", 3.0),
        ("the old, grey moron", 3.0),
        ("the very old, grey and utter moron", 3.0),
        ("the one two three four moron", 0.0),
        ("moron is here", 3.0),
        ("moron one two three four is here", 0.0),
        ("you moron", 4.5),
        ("moron, you", 4.5),
        ("moron one two three four five you", 4.5),
        ("you are a moron", 4.5),
        ("you came. a moron left", 3.0),
        ("he is not a moron", 3.0 * 1.5 * 0.3),
        ("not never a moron", 3.0),
        ("not today. moron!", 0.0),
        ("it said moron", 3.0 * 0.6),
        ('it said "a moron. and scum" but moron', 3.0 * 0.6 + 2.0 * 0.6 + 3.0),
        ("they kill it", 0.0),
        ("kill the process", 0.0),
        ("i will kill the process", 0.0),
        ("i will kill them all", 3.0),
        ("kill yourself", 3.0),
        ("kill all of you", 0.0),
        ("i will not kill you", 3.0 * 0.3),
        ("we hurt the moron and you", (2.0 + 3.0) * 1.5),
        ("you left", 0.0),
        ("réeuxpa!! «scum»", 0.0),
        ("the!! réeuxpa!!", 1.0),
        ("", 0.0),
    ],
)
def test_clauses(text, want):
    assert weight(text) == pytest.approx(want)


def brute(symbols, weights):
    """Every clause by the rules: each choice of insults and harms, the heaviest that is whole."""
    out, quoted, clause = [], False, []
    for symbol in [*symbols, (END, 0.0)]:
        if symbol[0] != END:
            clause.append(symbol)
            continue
        kinds = [k for k, _ in clause]
        negated = reported = False
        factors = []
        for kind in kinds:
            factors.append((weights.negated if negated else 1.0) * (weights.reported if reported or quoted else 1.0))
            negated ^= kind == NEGATION
            if kind == QUOTE:
                quoted, reported = (False, False) if quoted else (reported, False)
            elif kind == REPORT and not quoted:
                reported = True
        some = [k for k, kind in enumerate(kinds) if kind >= HARM]
        best = 0.0
        for r in range(len(some) + 1):
            for taken in itertools.combinations(some, r):
                if whole(kinds, set(taken)):
                    best = max(best, sum(clause[k][1] * factors[k] for k in taken))
        if best:
            out.append(best * (weights.targeted if TARGET in kinds else 1.0))
        clause = []
    return out


def words_between(kinds, a, b):
    return sum(k != QUOTE for k in kinds[a + 1 : b])


def whole(kinds, taken):
    """Whether every taken insult and harm of a clause is part of a whole pattern."""
    linked = set()
    for k in sorted(taken):
        if kinds[k] == INSULT:
            before = [j for j in range(k) if (kinds[j] in (LINK, TARGET, REPORT) or j in linked) and words_between(kinds, j, k) <= GAP]
            if before:
                linked.add(k)
                continue
            later = [j for j in range(k + 1, len(kinds)) if kinds[j] == TARGET or (kinds[j] == INSULT and j in taken) or (kinds[j] == LINK and words_between(kinds, k, j) <= GAP)]
            first = later[0] if later else None
            while first is not None and kinds[first] == INSULT:  # insults in a row wait together
                k = first
                later = [j for j in range(k + 1, len(kinds)) if kinds[j] == TARGET or (kinds[j] == INSULT and j in taken) or (kinds[j] == LINK and words_between(kinds, k, j) <= GAP)]
                first = later[0] if later else None
            if first is None:
                return False
    waiting = None
    agent = False
    for k, kind in enumerate(kinds):
        if kind == QUOTE:
            continue
        if waiting == "alone" and kind != TARGET:
            return False
        if kind == TARGET:
            waiting = None
        elif kind == AGENT:
            agent = True
        elif kind == HARM and k in taken:
            if waiting is None:
                waiting = "agent" if agent else "alone"
    return waiting is None


def test_the_machine_finds_the_heaviest_of_all_paths():
    rnd = random.Random(5)
    weights = Weights()
    for _ in range(4000):
        kinds = rnd.choices([*SYMBOLS], [1, 1, 4, 1, 1, 1, 1, 1, 1.5, 2.5], k=rnd.randint(0, 14))
        symbols = [(k, round(rnd.uniform(0.5, 3), 2) if k >= HARM else 0.0) for k in kinds]
        assert clause_weights(iter(symbols), weights) == pytest.approx(brute(symbols, weights)), symbols


def test_isolated_words_of_the_closed_classes_have_no_weight():
    assert Reader(LEXICON).features("you left. not now. he said it. moron. kill.") == (0.0, 0.0, 0.0, 0.0)


def test_awkward_texts(spark):
    rows = awkward() + [(800, "you moron. " * 20000), (801, "x" * 200_000)]
    grammar = Grammar(LEXICON, [-3.0, 1.0, 1.0, 0.1, 0.1])
    found = score_documents(frame(spark, rows), grammar).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[800] > 0.9 > 0.5 > scores[801]
    assert score_documents(frame(spark, []), grammar).count() == 0


def test_fitting_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0), (3, 7)], "doc_id long, toxic long")
    grammar = fit(frame(spark, awkward()), labels)
    assert len({r["score"] for r in score_documents(frame(spark, awkward()), grammar).collect()}) == 1


def test_held_out_accuracy(spark):
    from pathlib import Path

    data = "/root/testdata/sf0.1"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    found = op3_toxicity(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    right = found.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert right[0] > 0.97 and right[1] > 0.85 and right[2] < 0.02, right
