import numpy as np
import pytest

from gleaner.llm import embedding
from gleaner.llm.embedding import link_vectors
from tests.llm.texts import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, links long"


def brute(rows, least=0.93):
    good = {}
    for k, (d, v, label) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or []], np.float32).astype(float)
        if d is not None and label is not None and len(x) and np.isfinite(x).all() and x.any():
            good[k] = x / np.linalg.norm(x)
    pairs = [(a, b) for a in good for b in good if b < a and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    ids = [r[0] for r in rows]
    n = {k: 0 for k in range(len(rows))}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    known = [d for d in ids if d is not None]
    root = components(set(known), [(ids[a], ids[b]) for a, b in pairs])
    return sorted((repr(d), n[k], root.get(d), d == root.get(d)) for k, d in enumerate(ids))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    return sorted((repr(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df, **options).collect())


def planted(seed, n, size, cosine=None):
    """Vectors of two labels with near copies, a chain and a hub."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = []
    for k in range(n):
        x = unit(rng.normal(size=size))
        out.append(x)
        for _ in range(rng.integers(0, 4)):
            z = unit(rng.normal(size=size))
            z = unit(z - z @ x * x)
            c = cosine or rng.uniform(0.9, 0.999)
            out.append(c * x + np.sqrt(1 - c * c) * z)
    return [(int(k), [float(c) for c in v.astype(np.float32)], int(k) % 2 if cosine is None else 0) for k, v in enumerate(out)]


def test_awkward_vectors(spark):
    rows = planted(1, 150, 8)
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0), (1004, [1.0, None] * 4, 0), (1005, [float("inf")] + [1.0] * 7, 1)]
    rows += [(1006, rows[0][1], None), (1007, rows[0][1], rows[0][2]), (1008, rows[0][1], rows[0][2]), (-4, rows[3][1], rows[3][2]), (None, rows[0][1], 0), (None, None, None)]
    rows += [(1009, [1.0, 0.0], 0), (1010, [2.0, 0.1], 0), (1011, [3e30] * 8, 1), (1012, [1e-30] * 8, 1), (1013, [-0.0] * 7 + [1.0], 1), (1014, [0.0] * 7 + [1.0], 1)]
    assert run(spark, rows, pivots=16, near=8, shared=1) == brute(rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rows = planted(2, 120, 8)
    assert run(spark, rows, pivots=8, near=4, shared=1) == brute(rows)


def test_recall_at_the_threshold(spark):
    rows = planted(3, 700, 64, 0.931)
    found, want = run(spark, rows), brute(rows)
    got, every = sum(r[1] for r in found), sum(r[1] for r in want)
    assert got <= every and got >= 0.98 * every, (got, every)


@pytest.mark.parametrize("label", [2000, 200_000, 20_000_000])
def test_recall_with_the_parameters_of_larger_labels(spark, label):
    """Pivots and shared pivots of a label of that size, on vectors few enough for brute force."""
    pivots = min(512, embedding.pivots_for(label))
    rows = planted(4, 500, 64, 0.931)
    found, want = run(spark, rows, pivots=pivots, shared=embedding.shared_for(pivots)), brute(rows)
    got, every = sum(r[1] for r in found), sum(r[1] for r in want)
    assert got <= every and got >= 0.97 * every, (got, every)


def test_counting_shared_pivots():
    rng = np.random.default_rng(7)
    left, right = (np.sort(np.array([rng.choice(12, 5, replace=False) for _ in range(40)]), axis=1) for _ in range(2))
    left, right = left[(left == 6).any(axis=1)], right[(right == 6).any(axis=1)]
    found = {(int(a), int(b)) for i, j in embedding.candidates(left, right, 3, 6) for a, b in zip(i, j)}
    both = {(a, b): set(left[a]) & set(right[b]) for a in range(len(left)) for b in range(len(right))}
    assert found == {k for k, v in both.items() if len(v) >= 3 and min(v) == 6} and found


def test_many_lengths(spark):
    """More lengths than the sample of pivots holds."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(1, 3, 2 + k // 6).astype(np.float32)], 0) for k in range(120)]
    assert run(spark, rows, pivots=8, near=4, shared=2) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 0), (2, [1.0], None)]) == [("1", 0, 1, True), ("2", 0, 2, True)]
    assert run(spark, [(1, [1.0, 2.0], 0)]) == [("1", 0, 1, True)]
