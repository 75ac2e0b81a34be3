from itertools import permutations
import re

import pytest

from gleaner.llm.audit import audit_filters
from tests.llm.texts import SCHEMA, awkward, order

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
LAST = 2**63


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def brute(rows, labels, letters):
    """By applying the filters to documents one after the other."""
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", LAST), LAST if d is None else d)
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": first[t] < (LAST if d is None else d)}
        mine = [x for x in labels if d is not None and x[0] == d]
        docs.append((s or "", {f for f in letters if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        shapley = dict.fromkeys(letters, 0)
        found = []
        for o in map("".join, permutations(letters)):
            left = own
            for k, f in enumerate(o):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                found.append((f, (part, o, k + 1, len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(*x, shapley[f]) for f, x in found]
    return out


def rows_of():
    plain = " ".join(f"w{k}" for k in range(250))
    extra = [plain, plain + " $", plain.upper(), "w " * 300, "AB cd" * 50, plain, "Ä" * 98 + "AB", "Ä" * 97 + "ABC"]
    rows = [(d, t, [None, "", "s", "t"][k % 4]) for k, (d, t) in enumerate(awkward(n=40))]
    return rows + [(1000 + k, t, "s") for k, t in enumerate(extra)] + [(None, plain, "t"), (1000, "other", "t")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, s, None, "r", True, "d", "p", 1) for d, t, s in rows], SCHEMA)


@pytest.mark.parametrize("letters", ["ABCDE", "EA", "D"])
def test_as_filters_one_after_the_other(spark, letters):
    rows = rows_of()
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(30)] + [(4, 1, None), (None, 1, 1), (1001, 1, 1), (1001, 0, 0), (9999, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit_filters(frame(spark, rows), said, letters).select(COLUMNS).collect()
    assert order(map(tuple, found)) == order(brute(rows, labels, letters))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(frame(spark, []), none).count() == 0
    got = audit_filters(frame(spark, [(1, None, None)]), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r["part"], r["kept"], r["removed"]) for r in got] == [("", 0, 1)] + [("", 0, 0)] * 4


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7), (2, "a b", "x", 8)], "`the id` long, `a.text` string, `of-part` string, n int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit_filters(docs, none, "E", "of-part", "the id", "a.text").collect()
    assert [(r["kept"], r["removed"], r["shapley"]) for r in got] == [(1, 1, 1)]
