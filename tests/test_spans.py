import random

from gleaner.operators.components import connected_components
from gleaner.operators.spans import contained, locate_texts, overlapping


def rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        a = rnd.randint(0, 5000)
        out.append((rnd.randint(0, 3), k, a, a + rnd.choice([0, 1, 50, 1024, 3000])))
    return out


def test_joins_of_spans(spark):
    a, b = rows(1), rows(2)
    left, right = (spark.createDataFrame(x, "doc long, n long, start long, end long") for x in (a, b))
    found = [(r["outer_n"], r["inner_n"]) for r in contained(left, right, ["doc"]).collect()]
    assert sorted(found) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[2] and x[3] >= y[3])
    found = [(r["a_n"], r["b_n"]) for r in overlapping(left, right, ["doc"]).collect()]
    assert sorted(found) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_exact_places(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox jump; the quick brown fox jump"), (2, "nothing"), (3, "athe quick brown fox jumps"), (4, None), (5, "ab")], "id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jump"), (2, "absent words here"), (3, ""), (4, None), (5, "ab")], "item_id long, text string")
    found = {(r["item_id"], r["id"], r["start"], r["end"], r["unique_in_text"]) for r in locate_texts(items, docs).collect()}
    assert found == {(1, 1, 4, 28, False), (1, 3, 1, 25, True), (5, 5, 0, 2, True)}


def test_components(spark):
    rnd = random.Random(3)
    for n, m in ((1, 0), (50, 30), (300, 310)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 2000 + k) for k in range(50)] + [(None, 3)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert found == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
