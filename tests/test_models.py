"""Calls of models within their time, their attempts, and a captured search replayed."""

import time

import pytest
from pyspark.sql import functions as F

from gleaner.errors import EngineError
from gleaner.plans.index import Index, prepare
from gleaner.plans.models import Caller, Live, Replayed, keyed, misses
from gleaner.plans.search import observe, search
from gleaner.sources.limits import Passing
from gleaner.sources.providers import HashEmbedding, NoExpansion, OverlapRerank, SwappedExpansion, anchors


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.waits.append(s)
        self.now += s


def answers(clock, *steps):
    """A function that takes and gives what each step says: seconds, and a failure or an answer."""
    left = list(steps)

    def call():
        seconds, what = left.pop(0)
        clock.now += seconds
        if isinstance(what, Exception):
            raise what
        return what

    call.left = left
    return call


def called(*steps, left=30_000.0, **options):
    clock = Clock()
    function = answers(clock, *steps)
    out = Caller("rerank", clock=clock, sleep=clock.sleep, **options).call(function, left=left)
    return out, clock.waits, len(function.left)


def test_only_what_may_pass_is_tried_again_once():
    out, waits, unused = called((1, Passing()), (1, [1]), (1, [2]))
    assert (out.answer, out.error, waits, unused) == ([1], None, [0.25], 1) and out.left == 27_750
    out, waits, _ = called((1, Passing(after=3.0)), (1, [1]))
    assert (out.answer, waits) == ([1], [3.0])
    out, waits, unused = called((1, Passing()), (1, Passing()), (1, [2]))
    assert (out.answer, out.error, unused) == (None, "RERANK_FAILED", 1) and [c["outcome"] for c in out.calls] == ["FAILED", "FAILED"]
    out, waits, unused = called((1, ZeroDivisionError()), (1, [1]))
    assert (out.error, waits, unused) == ("RERANK_FAILED", [], 1)


def test_time_is_a_budget():
    out, waits, unused = called((1, Passing(after=5.0)), (1, [1]), left=4_000.0)
    assert (out.error, waits, unused) == ("RERANK_FAILED", [], 1)  # the wait doesn't fit
    out, _, _ = called((5, [1]), left=4_000.0)
    assert (out.answer, out.error, out.left) == (None, "SEARCH_TIMEOUT", 0.0)
    out, _, unused = called((1, [1]), left=0.0)
    assert (out.error, unused, out.calls) == ("SEARCH_TIMEOUT", 1, [])
    began = time.monotonic()
    out = Caller("embed").call(time.sleep, 3, left=200.0)
    assert out.error == "SEARCH_TIMEOUT" and time.monotonic() - began < 2  # the function still sleeps
    out = Caller("embed", longest=50.0, attempts=1).call(time.sleep, 0.5, left=5_000.0)
    assert out.error == "EMBEDDING_FAILED" and out.left > 4_000 and out.calls[0]["outcome"] == "LATE"


def test_bytes_and_costs():
    assert called((1, "x" * 100), bytes=50)[0].error == "RERANK_FAILED"
    for cost, want in ((0.5, 0.5), (0, 0.0), (None, None), (-1, None), (float("nan"), None), (float("inf"), None), ("1", None), (True, None)):
        assert called((1, [1]), cost=lambda kind, answer, cost=cost: cost)[0].calls[0]["cost"] == want
    assert [c["cost"] for c in called((1, Passing()), (1, [1]), cost=lambda kind, answer: 2.0)[0].calls] == [None, 2.0]


class Slow:
    def __init__(self, seconds):
        self.seconds = seconds

    def expand(self, query):
        time.sleep(self.seconds)
        return {"lex": [], "vec": [], "hyde": []}


class Picky:
    """Reranks, but for one question."""

    def rerank(self, query, documents):
        if "gamma" in query:
            raise ValueError("no")
        return OverlapRerank().rerank(query, documents)


MODEL = HashEmbedding(16)


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models") / "index")
    texts = [(f".agent/knowledge/{k}.md", f"# Part {k}\n\nalpha beta gamma delta {k} words of part {k}\n") for k in range(6)]
    prepare(spark, spark.createDataFrame(texts, "source string, text string"), root, MODEL)
    return Index(spark, root, MODEL)


def test_a_slow_stage_uses_up_the_next_ones_time(spark, opened):
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    with pytest.raises(EngineError, match="SEARCH_TIMEOUT"):
        search(spark, opened, asked, MODEL, Slow(1.0), OverlapRerank(), seconds=0.7)
    assert search(spark, opened, asked, MODEL, Slow(0.2), OverlapRerank(), seconds=30.0).count() > 0


def test_a_captured_search_is_replayed(spark, opened):
    asked = [(1, "alpha beta words"), (2, "gamma delta"), (3, "alpha beta words"), (4, "alpha beta words"), (5, " ")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    price = lambda kind, answer: {"expand": 1.0, "embed": 0.25 * len(answer)}.get(kind)
    live = Live(MODEL, SwappedExpansion(), Picky(), price)
    seen = observe(spark, opened, queries, live)
    outcomes = {r["query_id"]: r for r in seen.outcomes.collect()}
    assert {k: (r["status"], r["code"]) for k, r in outcomes.items()} == {1: ("PASS", None), 2: ("FAIL", "RERANK_FAILED"), 3: ("PASS", None), 4: ("PASS", None), 5: ("FAIL", "QUERY_TOO_LARGE")}
    vectors = {1: 2, 2: 2, 3: 2, 4: 2, 5: 0}
    assert {k: (r["known_cost"], r["unknown_costs"]) for k, r in outcomes.items()} == {k: (1 + 0.25 * n, 1) if n else (0.0, 0) for k, n in vectors.items()}
    want = sorted(map(tuple, seen.results.collect()))
    assert {r[0] for r in want} == {1, 3, 4}

    good = queries.where("query_id in (1, 3, 4)")
    record = seen.record.join(keyed("expand", queries.where("query_id = 2").select("query_id", F.lit(0).alias("place"), F.col("query").alias("request"))).select("kind", "digest", "ordinal"), ["kind", "digest", "ordinal"], "left_anti")
    embedded = ["gamma delta", "delta gamma"]
    record = record.where(~F.col("request").isin(embedded)).persist()
    for parts in (1, 7):
        models = Replayed(record.repartition(parts), MODEL.size)
        got = search(spark, opened, good.repartition(parts), models)
        assert sorted(map(tuple, got.collect())) == want and models.violations().count() == 0
    with pytest.raises(EngineError, match="not used"):
        search(spark, opened, good.where("query_id < 4"), Replayed(record, MODEL.size))
    with pytest.raises(EngineError, match="no recorded answer"):
        search(spark, opened, good.unionByName(spark.createDataFrame([(9, "alpha beta words")], good.schema)), Replayed(record, MODEL.size))
    with pytest.raises(EngineError, match="twice"):
        search(spark, opened, good, Replayed(record.unionByName(record), MODEL.size))


def test_misses_both_ways(spark):
    rows = lambda n, text: [(k, 0, text, 1.0) for k in range(n)]
    schema = "query_id long, place int, request string, left double"
    asked = keyed("embed", spark.createDataFrame(rows(3, "a") + rows(1, "b"), schema))
    record = keyed("embed", spark.createDataFrame(rows(2, "a") + rows(2, "c"), schema)).withColumn("answer", F.lit("[]"))
    found = misses("embed", asked, record).groupBy("rule").count().collect()
    assert {r["rule"]: r["count"] for r in found} == {"request without answer": 2, "answer without request": 2}
    assert misses("expand", asked.where("false"), record).count() == 0


@pytest.mark.parametrize(
    "query, want",
    [
        ("see `a b` and std::vector, foo:-x", ["a b", "std::vector", "foo:-x"]),
        ("docs/setup.md. --cache user_id 25% 1,5", ["docs/setup.md", "--cache", "user_id", "25", "25%", "1", "1,5", "5"]),
        ("HTTPServer iPhone ABC abc Abc a-b -x --", ["HTTPServer", "iPhone", "-x"]),
        ("x.y z. .hidden a: b:c d::e f: :g", ["x.y", "b:c", "d::e"]),
        ("`x_1 --y` x_1", ["x_1 --y", "x_1", "--y"]),
        ("cost -3.5 (+4) v2 10:30 a+b 3rd Ⅷ", ["-3.5", "+4", "v2", "10:30", "3rd", "Ⅷ"]),
        ("", []),
    ],
)
def test_anchors(query, want):
    assert anchors(query) == want
