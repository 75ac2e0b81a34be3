import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.errors import Code, EngineError
from gleaner.operators import quality
from gleaner.plans.index import Index, prepare
from gleaner.plans.search import search
from gleaner.sources.limits import Passing, Retrying, check_request, format_query
from gleaner.sources.manifest import manifest_violations, read_manifest
from gleaner.sources.providers import HashEmbedding, NoExpansion, OverlapRerank

MODEL = HashEmbedding(32)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index") / "index")
    rows = [(".agent/knowledge/a.md", "# A\n\nalpha beta\n\n## B\n\ngamma gamma"), (".agent/knowledge/b.md", "delta"), (".agent/knowledge/none.md", "")]
    prepare(spark, spark.createDataFrame(rows, "source string, text string"), root, MODEL)
    return Index(spark, root)


def broken(df):
    return {r["rule"] for r in df.collect()}


def test_spans(index):
    spans, sources = index.table("spans"), index.table("sources")
    assert broken(quality.span_violations(spans, sources)) == set()
    assert "spans do not tile the source" in broken(quality.span_violations(spans.where("start > 0"), sources))
    moved = spans.withColumn("start", F.col("start") + 1)
    assert {"length of a span", "passage identity"} <= broken(quality.span_violations(moved, sources))
    assert {"passage repeated"} <= broken(quality.span_violations(spans.unionByName(spans), sources))
    assert {"path", "source repeated"} <= broken(quality.span_violations(spans, sources.unionByName(sources).withColumn("source", F.lit("../x.md"))))


def test_vectors(index):
    passages, vectors = index.passages(), index.embedded().select("chunk_hash", "embedding")
    assert broken(quality.vector_violations(passages, vectors, 32)) == set()
    assert broken(quality.vector_violations(passages, vectors.limit(0), 32)) == {"no vector"}
    assert broken(quality.vector_violations(passages, vectors, 16)) == {"vector"}
    other = vectors.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    assert broken(quality.vector_violations(passages, vectors.unionByName(other), 32)) == {"different vectors of an input"}


def test_lexical(index):
    lex, passages = index.lexical(), index.passages()
    check = lambda p=lex.postings, l=lex.lengths, s=lex.stats: broken(quality.lexical_violations(p, l, s, passages))  # noqa: E731, E741
    assert check() == set()
    assert check(p=lex.postings.withColumn("tf", F.col("tf") + 1)) == {"length"}
    assert check(p=lex.postings.withColumn("term", F.upper("term"))) == {"term"}
    assert "statistics" in check(s=lex.stats.withColumn("n", F.col("n") + 1))
    assert "passage without lengths" in check(l=lex.lengths.limit(0))


def test_hits(spark, index):
    queries = spark.createDataFrame([(1, "gamma beta")], "query_id long, query string")
    hits = search(spark, index, queries, MODEL, NoExpansion(), OverlapRerank())
    sources = index.table("sources")
    assert hits.count() and broken(quality.hit_violations(hits, sources)) == set()
    assert broken(quality.hit_violations(hits.withColumn("snippet", F.lit("other")), sources)) == {"snippet is not its span"}
    assert broken(quality.hit_violations(hits.withColumn("rank", F.col("rank") + 1), sources)) == {"ranks"}


def manifest():
    text = b"one\r\ntwo"
    good = {"original": "docs/x.md", "mapped": ".agent/knowledge/docs/x.md", "originalHash": hashlib.sha256(text).hexdigest(), "normalizedHash": hashlib.sha256(b"one\ntwo").hexdigest(), "bytes": len(text)}
    project = lambda k: {"id": f"p{k}", "url": "https://example.org/a/b", "commit": "a" * 40, "license": {"status": "MIT", "files": [{"path": "LICENSE", "hash": "b" * 64}]}, "files": [dict(good)]}
    return {"version": 1, "projects": [project(k) for k in range(3)]}, text


def test_manifest(spark, tmp_path):
    def check(value, sources=None):
        path = tmp_path / f"{hashlib.sha256(json.dumps(value).encode()).hexdigest()[:9]}.json"
        path.write_text(json.dumps(value))
        return broken(manifest_violations(read_manifest(spark, str(path)), sources))

    value, text = manifest()
    kept = spark.createDataFrame([(f"p{k}", ".agent/knowledge/docs/x.md", bytearray(text)) for k in range(3)], "project string, mapped string, content binary")
    assert check(value, kept) == set()
    assert check(value, kept.where("project <> 'p1'")) == {"file missing"}
    assert check(value, kept.withColumn("content", F.lit(b"\xff"))) == {"size differs", "digest differs", "normalised digest differs"}
    for change, rule in (
        (lambda p: p.update(commit="main"), {"commit"}),
        (lambda p: p.update(id="p1"), {"projects", "file repeated"}),
        (lambda p: p["files"][0].update(original="../x.md", mapped=".agent/knowledge/../x.md"), {"path"}),
        (lambda p: p["files"][0].update(mapped="x.md"), {"mapping"}),
        (lambda p: p["files"][0].update(bytes=0, originalHash="x"), {"digest", "size"}),
        (lambda p: p["license"]["files"][0].update(hash="x"), {"notice"}),
        (lambda p: p.update(files=[]), {"path", "mapping", "digest", "size"}),
    ):
        value, _ = manifest()
        change(value["projects"][0])
        assert check(value) == rule, rule


def test_requests():
    assert format_query("why", instruction="Q: ") == "Q: why"
    for bad in ("", "  ", "x" * 20_000):
        with pytest.raises(EngineError) as e:
            format_query(bad)
        assert e.value.code == Code.QUERY_TOO_LARGE
    assert check_request("q", ["a"] * 40)
    for documents in ([], ["a"] * 41, [""], ["x" * 17_000], ["é" * 20_000]):
        with pytest.raises(EngineError):
            check_request("q", documents)


def test_retries_and_record():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    def failing(times, after=None):
        left = [times]

        def f(x):
            if left[0]:
                left[0] -= 1
                raise Passing("later", after)
            return x

        return f

    retry = Retrying(clock=lambda: now[0], sleep=sleep)
    assert retry.call(failing(3), 7) == 7 and waits == [1.0, 2.0, 4.0]
    assert retry.call(failing(1, 9.0), 7) == 7 and waits[-1] == 9.0
    for f in (failing(4), failing(1, 500.0)):
        with pytest.raises(EngineError):
            retry.call(f, 7)
    with pytest.raises(ZeroDivisionError):
        retry.call(lambda: 1 / 0)
