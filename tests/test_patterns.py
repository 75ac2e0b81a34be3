"""Places of many texts in many others, changes between versions, groups of comparisons, views."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.baseline import rank_baseline, rank_baseline_batch
from gleaner.operators.compare import bootstrap, bootstrap_groups, compare_groups
from gleaner.operators.contract import changes, same_contract
from gleaner.operators.fusion import fuse, fuse_views
from gleaner.operators.patterns import places
from gleaner.operators.spans import locate_texts


def test_places(spark):
    patterns = ["ab", "b", "aba", "...", " ", "日本", "é", "zz", "", None, "ab", "x" * 50, "😀a"]
    texts = [(1, "ababa ... éé"), (2, None), (3, ""), (4, "日本日本 😀a " + "x" * 52), (1, "b"), (None, "ab")]
    want = sorted(((p, i, k, k + len(p)) for p in {p for p in patterns if p} for i, t in texts for k in range(len(t or "")) if t.startswith(p, k)), key=repr)
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    rows = spark.createDataFrame(texts, "id long, text string")
    for block in (1 << 20, 8, 1):
        found = sorted(map(tuple, places(asked, rows, block).collect()), key=repr)
        assert found == want
    assert places(asked.where("pattern = ''"), rows).count() == 0 and places(asked, rows.where("false")).count() == 0


def test_located_items_need_no_word(spark):
    items = spark.createDataFrame([(1, "..."), (2, "b"), (3, "no"), (4, "aa")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "a... b"), (8, "aaa ....")], "id long, text string")
    found = {tuple(r) for r in locate_texts(items, docs).collect()}
    assert found == {(1, 7, 1, 4, True), (1, 8, 4, 7, False), (2, 7, 5, 6, True), (4, 8, 0, 2, False)}


def test_changes(spark):
    old = [(1, "a", 1), (1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4), (None, "n", 5), (6, "x", 6), (6, "y", 7)]
    new = [(1, "a", 1), (2, "b", 2), (3, "null", 3), (5, "e", 4), (None, "n", 5), (6, "y", 7), (6, "x", 6)]
    a = spark.createDataFrame(old, "k long, s string, n int")
    b = spark.createDataFrame(new, "k long, s string, n int").select("n", "k", "s")
    assert {tuple(r) for r in changes(a, b, ["k"]).collect()} == {("changed", 1, 2, 1), ("changed", 3, 1, 1), ("lost", 4, 1, 0), ("added", 5, 0, 1)}
    assert same_contract(a, a.repartition(3), ["k"]).count() == 0
    assert {r["change"] for r in same_contract(a, b, ["k"], ("added", "lost")).collect()} == {"changed"}
    with pytest.raises(ValueError):
        changes(a, b.drop("n"), ["k"])


def drawn(deltas, samples=2000, state=20260905):
    """The interval by the sequence of numbers, one after the other."""
    means = []
    for _ in range(samples):
        total = 0.0
        for _ in deltas:
            state = (state * 1664525 + 1013904223) % 2**32
            total += deltas[int(state / 2**32 * len(deltas))]
        means.append(total / len(deltas))
    means.sort()
    return round(means[int(samples * 0.025)], 6), round(means[int(samples * 0.975)], 6)


def test_groups_share_draws(spark):
    rnd = random.Random(3)
    groups = {("a", 1): 12, ("a", 2): 12, ("b", 1): 7, ("c", 1): 1, ("d", 1): 1013}
    deltas = {g: [round(rnd.uniform(-1, 1), 3) for _ in range(n)] for g, n in groups.items()}
    rows = [(*g, q, d) for g, own in deltas.items() for q, d in enumerate(own)] + [("a", 1, 99, None), ("e", 1, 1, None)]
    pairs = spark.createDataFrame(rows, "x string, y int, question long, delta double").repartition(5)
    found = {(r["x"], r["y"]): (r["low"], r["high"]) for r in bootstrap_groups(pairs, ["x", "y"], 200).collect()}
    assert found == {g: drawn(own, 200) for g, own in deltas.items()}
    assert tuple(bootstrap(pairs.where("x = 'b'"), 200).first()) == drawn(deltas["b", 1], 200)
    assert tuple(bootstrap(pairs.where("x = 'e'")).first()) == (None, None)


def test_compared_groups(spark):
    left = spark.createDataFrame([("m", 1, 0.0), ("m", 2, 1.0), ("m", 3, 1.0), ("m", 4, None), ("m", 5, 1.0)], "metric string, question long, mean double")
    right = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 1.0), ("m", 3, 0.0), ("m", 4, 1.0), ("m", 6, 1.0)], left.schema)
    r = compare_groups(left, right, ["metric"]).first()
    assert (r["questions"], r["wins"], r["ties"], r["losses"], r["mean_delta"], r["missing"], r["low"], r["high"]) == (3, 1, 1, 1, 0.0, 3, -1.0, 1.0)


def test_views_are_as_fused_apart(spark):
    rnd = random.Random(1)
    rows = [(q, c, c != "lex0", i, k + 1) for q in range(3) for c in ("bm25", "cosine", "lex0") for k, i in enumerate(rnd.sample(range(30), 12))]
    lists = spark.createDataFrame(rows, "query_id long, channel string, is_original boolean, id long, rank long")
    views = {"one": F.col("channel") == "bm25", "original": F.col("is_original"), "all": F.lit(True), "none": F.lit(False)}
    got = fuse_views(lists, views).collect()
    for name, test in views.items():
        want = sorted(map(tuple, fuse(lists.where(test)).collect()))
        assert sorted((r["query_id"], r["id"], r["score"], r["protected"]) for r in got if r["view"] == name) == want


def test_baseline_of_a_batch(spark):
    rnd = random.Random(6)
    words = ["alpha", "beta", "a.b", "Gamma", "x_1", "delta"]
    docs = [(k, f"s/{rnd.choice(words)}{k % 4}", rnd.choice(["", "alpha beta"]), rnd.choice([None, "", " ".join(rnd.choices(words, k=9))])) for k in range(40)]
    asked = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 3))), [rnd.uniform(-1, 1) for _ in range(4)]) for k in range(8)]
    vectors = [(k, [rnd.uniform(-1, 1) for _ in range(4)]) for k in range(38)]
    d = spark.createDataFrame(docs, "id long, source string, heading string, text string")
    a = spark.createDataFrame(asked, "query_id long, query string, v array<float>")
    v = spark.createDataFrame(vectors, "id long, v array<float>")
    from gleaner.functions.vectors import cosine

    pairs = d.join(v, "id").join(a.withColumnRenamed("v", "q")).withColumn("cosine", cosine(F.col("v"), F.col("q"))).withColumn("text", F.coalesce("text", F.lit("")))
    want = sorted(map(tuple, rank_baseline(pairs.select("query_id", "query", "id", "source", "heading", "text", "cosine")).collect()))
    assert len(want) > 10 and sorted(map(tuple, rank_baseline_batch(a, v, d).collect())) == want
