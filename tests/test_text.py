import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators.spans import line_starts


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("API_KEY_MISSING readSnapshot HTTPServer .agent/knowledge/auth.md E_AUTH_403", "api_key_missing api key missing readsnapshot read snapshot httpserver http server agent/knowledge/auth.md agent knowledge auth md e_auth_403 e auth 403"),
        ("foo_foo foo_foo Łódź ŻółtySerwer HTTPŻądanie", "foo_foo foo foo_foo foo łódź żółtyserwer żółty serwer httpżądanie http żądanie"),
        ("plain words, 1e-3 a.b/c", "plain words 1e-3 1e 3 a.b/c a b c"),
        ("constructor __proto__", "constructor proto"),
        ("", ""),
        ("!?", ""),
    ],
)
def test_terms(spark, text, want):
    assert one(spark, T.terms(F.col("t")), t=text) == want.split()


def test_the_shortcut_for_plain_words_changes_nothing(spark):
    words = ["iPhone", "ABC", "Abc", "aB", "ÄÖ", "x1Y", "İConfig", "ΣΑΣ", "UTF-8", "é", "HTTPServer2Go"]
    slow = lambda m: F.array_distinct(F.concat(F.array(F.lower(m)), F.flatten(F.transform(F.split(m, T.SEPARATORS), lambda p: F.concat(F.array(F.lower(p)), F.transform(F.split(F.regexp_replace(F.regexp_replace(p, T.HUMP, "$1 $2"), T.ACRONYM, "$1 $2"), " "), F.lower))))))
    df = spark.createDataFrame([(w,) for w in words], "m string")
    assert df.where(T.match_terms(F.col("m")) != slow(F.col("m"))).collect() == []


def test_identities(spark):
    assert one(spark, F.sha2(F.col("t"), 256), t="abc").startswith("ba7816bf")
    assert one(spark, T.source_hash(F.col("t")), t="a\r\nb\rc") == "sha256:" + hashlib.sha256(b"a\nb\nc").hexdigest()
    body = "é😀"
    key = json.dumps([".agent/knowledge/a.md", 3, 5, hashlib.sha256(body.encode()).hexdigest()], separators=(",", ":"))
    found = one(spark, T.passage_id(F.lit(".agent/knowledge/a.md"), F.lit(3), F.lit(5), F.col("t")), t=body)
    assert found == "sha256:" + hashlib.sha256(key.encode()).hexdigest()


@pytest.mark.parametrize("path, safe", [(".agent/knowledge/a.md", True), (".agent/decisions/x/y.md", True), (".agent/knowledge/../a.md", False), (".agent/knowledge//a.md", False), ("a.md", False), (".agent/knowledge/a\\b.md", False), (".agent/knowledge/./a.md", False), (".agent/knowledge/a.txt", False)])
def test_safe_source(spark, path, safe):
    assert one(spark, T.safe_source(F.col("p")), p=path) is safe


def test_positions_count_characters(spark):
    text = "a😀\n\nbé\nlast"
    starts = [r["start"] for r in line_starts(spark.createDataFrame([(text,)], "text string")).orderBy("line").collect()]
    assert starts == [0, 3, 4, 7]
    for at in range(len(text)):
        line = max(k for k, s in enumerate(starts) if s <= at)
        assert one(spark, T.line_of(F.col("t"), F.lit(at)), t=text) == line + 1
        assert one(spark, T.column_of(F.col("t"), F.lit(at)), t=text) == at - starts[line] + 1


def test_lines_of_awkward_rows(spark):
    rows = [(1, ""), (2, None), (3, "a\n\n"), (3, "a\n\n"), (4, "é😀\n" * 20_000)]
    df = spark.createDataFrame(rows, "`my id` long, text string").withColumn("line", F.lit("x")).withColumnRenamed("line", "a.b")
    found = sorted((r["my id"], r["line"], r["start"]) for r in line_starts(df).collect())
    want = [(d, k + 1, sum(len(x) + 1 for x in t.split("\n")[:k])) for d, t in rows[:4] if t is not None for k in range(len(t.split("\n")))] + [(4, k + 1, 3 * k) for k in range(20_001)]
    assert found == sorted(want) and line_starts(df).columns == ["my id", "a.b", "line", "start"]
    assert line_starts(df.limit(0)).count() == 0


def test_snippets(spark):
    assert one(spark, T.snippet(F.col("t")), t="x" * 400) == "x" * 400
    assert one(spark, T.snippet(F.col("t")), t="😀" * 401) == "😀" * 400 + "…"


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, None), (6, [1.0]), (7, [1.0, None])], "id int, v array<float>")
    assert {r["id"] for r in df.where(V.valid(F.col("v"), 2)).collect()} == {1}
    assert df.where("id = 1").select(V.norm(F.col("v"))).first()[0] == 5.0
    assert df.where("id = 1").select(V.cosine(F.col("v"), F.array(F.lit(-4.0), F.lit(3.0)))).first()[0] == 0.0
