import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import substring
from gleaner.llm.substring import cut_documents, remove_repeats
from tests.llm.texts import awkward, cut_brute, frame, order


def run(spark, rows, window, **options):
    found = remove_repeats(frame(spark, rows), window, **options).select("row.doc_id", "n_words", "n_removed", "kept_text")
    return order(map(tuple, found.collect()))


@pytest.mark.parametrize("window", [1, 5, 13])
def test_matches_brute_force(spark, window):
    rows = awkward()
    assert run(spark, rows, window) == order(cut_brute(rows, window))


def test_a_full_sketch_changes_nothing(spark):
    rows = awkward(2)
    assert run(spark, rows, 5, load=0.01) == order(cut_brute(rows, 5))


def test_small_blocks_slices_and_shards_change_nothing(spark, monkeypatch):
    rows = awkward(3)
    monkeypatch.setattr(substring, "BLOCK", 300)
    monkeypatch.setattr(substring, "SLICE_BITS", 8)
    monkeypatch.setattr(substring, "SHARD", 40)
    assert run(spark, rows, 5) == order(cut_brute(rows, 5))


def answered(sketch, tasks):
    """What each task is told by all slices."""
    sent = {}
    for number, keys in enumerate(tasks):
        for at, part in sketch.parts(keys):
            sent.setdefault(at, []).append((number, part))
    told = [{} for _ in tasks]
    for at, rows in sent.items():
        for (number, _), bits in zip(rows, sketch.answer([part for _, part in rows])):
            told[number][at] = bits
    return told


@pytest.mark.parametrize("load", [0.01, 1, 8])
def test_sketch_never_loses_a_repeat(load):
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    twice = keys[:500]
    sketch = substring.Sketch(5000, load, 9)
    tasks = [keys, twice, np.concatenate((keys[600:610], keys[600:610] + np.uint64(1), keys[600:610] + np.uint64(1)))]
    told = answered(sketch, tasks)
    assert sketch.repeated(twice, told[1]).all() and sketch.repeated(keys, told[0])[:500].all() and sketch.repeated(keys, told[0])[600:610].all()
    assert sketch.repeated(tasks[2], told[2]).all()  # in another task, or twice in this one


@pytest.mark.parametrize("windows", [20_000, 200_000, 1_000_000])
def test_the_share_that_passes_is_the_same_at_any_size(windows):
    """Slices of 4096 cells stand for the production size: the number of slices grows, not the share."""
    rng = np.random.default_rng(2)
    tasks = [rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(windows // 20_000)]
    sketch = substring.Sketch(windows, substring.LOAD, 12)
    told = answered(sketch, tasks)
    passed = np.mean([sketch.repeated(k, t).mean() for k, t in zip(tasks, told)])
    assert sketch.slices == -(-sketch.cells // 4096) and 0.005 < passed < 0.02, passed


def test_column_names(spark):
    docs = frame(spark, [(1, "a b c"), (2, "a b c d")]).withColumn("my col", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("c-d`e", F.array(F.lit(1.5)))
    out = cut_documents(docs, window=3)
    assert out.columns == docs.columns and {(r["doc_id"], r["text"], r["my col"], r["a.b"], r["c-d`e"][0]) for r in out.collect()} == {(1, "a b c", 1, "x", 1.5), (2, "d", 1, "x", 1.5)}


def test_spans_and_columns(spark):
    a = " ".join(f"w{k}" for k in range(20))
    docs = frame(spark, [(1, a), (2, "x  y " + a + "\tz"), (3, "no  change\n")])
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["removed"]] for r in remove_repeats(docs).select("row.doc_id", "removed").collect()}
    assert spans == {1: [], 2: [(2, 22)], 3: []}
    out = cut_documents(docs, length_col="n_chars")
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, a, None), (2, "x y z", 5), (3, "no  change\n", None)}


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    assert cut_documents(frame(spark, [])).count() == 0
    assert run(spark, [(1, None), (2, None)], 13) == [(1, 0, 0, ""), (2, 0, 0, "")]
