import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import baseline, excerpt, fusion, lexical, similarity
from tests.windows import best_window, occurrences


def scores(spark, rows, query, fields=None):
    df = spark.createDataFrame(rows, "id string, body string, headings string, path string")
    index = lexical.build_index(df, "id", fields or {"body": "body", "headings": "headings", "path": "path"})
    queries = spark.createDataFrame([(1, query)], "query_id long, text string")
    found = lexical.top(lexical.bm25(index, lexical.query_terms(queries, "query_id", "text")))
    return [(r["id"], r["score"]) for r in found.orderBy("rank").collect()], index


def test_bm25_by_hand(spark):
    rows = [("a", "rare common common", "", ""), ("b", "common", "", ""), ("c", "other other", "", "")]
    assert scores(spark, rows, "rare rare")[0] == [("a", round(0.8142733421229427, 6))]
    assert scores(spark, rows, "absent")[0] == []


def test_headings_and_paths_weigh_twice(spark):
    rows = [("body", "target", "", ""), ("heading", "", "target", ""), ("path", "", "", "target")]
    found, index = scores(spark, rows, "target")
    assert [x for x, _ in found] == ["heading", "path", "body"]
    assert found[0][1] == found[1][1] == pytest.approx(2 * found[2][1], abs=2e-6)
    assert {(r["field"], r["total_length"], r["n"]) for r in index.stats.collect()} == {("body", 1, 3), ("headings", 1, 3), ("path", 1, 3)}


def test_index_counts(spark):
    df = spark.createDataFrame([(1, "a b a_b"), (2, ""), (3, None), (4, "B b")], "id long, body string")
    index = lexical.build_index(df, "id", {"body": "body"})
    assert {(r["term"], r["tf"], r["df"]) for r in index.terms().collect()} == {("a", 2, 1), ("b", 4, 2), ("a_b", 1, 1)}
    assert {(r["id"], r["length"]) for r in index.lengths.collect()} == {(1, 5), (2, 0), (3, 0), (4, 2)}


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "BLOCK", 7 * 4 * 6)
    rnd = random.Random(1)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(5)]) for k in range(40)] + [(100, [1.0] * 5), (101, [2.0] * 5), (102, [-1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = similarity.cosine_top(df.where("id % 10 = 0"), df, 5).collect()
    for q, v in rows:
        if q % 10 == 0:
            cos = lambda w: round(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)), 6)
            want = sorted(((-cos(w), k) for k, w in rows))[:5]
            assert [(r["id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k, -s) for s, k in want]
    others = similarity.cosine_top(df.where("id = 100"), df, 50, itself=False).collect()
    assert 100 not in {r["id"] for r in others} and len(others) == 42


def greedy(fused, depth=40):
    """The sequential form: protected first, then the source cap, then the rest."""
    order = sorted(fused, key=lambda r: (-r[2], r[1], r[0]))
    kept = [r for r in order if r[3]]
    per = Counter(r[1] for r in kept)
    late = []
    for r in order:
        if not r[3] and len(kept) < depth:
            if per[r[1]] < 2:
                per[r[1]] += 1
                kept.append(r)
            else:
                late.append(r)
    kept += late[: depth - len(kept)]
    return [r[0] for r in sorted(kept, key=lambda r: (-r[2], r[1], r[0]))]


def test_protected_fusion_is_the_greedy_loop(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for q in range(40):
        own = []
        safe = rnd.randint(0, 16)
        for k in range(rnd.randint(0, 80)):
            own.append((k, f"s{rnd.randint(0, rnd.choice([2, 30]))}", round(rnd.random(), 1), k < safe))
        want[q] = greedy(own)
        rows += [(q, *r) for r in own]
    df = spark.createDataFrame(rows, "query_id long, id long, source string, score double, protected boolean")
    found = defaultdict(list)
    for r in fusion.protect(df).orderBy("query_id", "fused_rank").collect():
        found[r["query_id"]].append(r["id"])
    assert {q: w for q, w in want.items() if w} == dict(found)


def test_fusion_weights_and_shared_files(spark):
    lists = [(1, "vec", True, f"v{k:02}", k + 1) for k in range(40)] + [(1, "lex", True, f"v{k:02}" if k < 8 else f"l{k:02}", k + 1) for k in range(40)]
    lists += [(1, "hyde", False, "h", 1), (1, "hyde", False, "h", 5), (1, "hyde", False, "late", 41)]
    fused = fusion.fuse(spark.createDataFrame(lists, "query_id long, channel string, is_original boolean, id string, rank int"))
    score = {r["id"]: r["score"] for r in fused.collect()}
    assert score["v00"] == round(4 / 61, 9) and score["h"] == round(1 / 61, 9) and score["v20"] == round(2 / 81, 9)
    named = fused.withColumn("source", F.when(F.col("id").startswith("v"), "shared").otherwise(F.col("id")))
    kept = fusion.protect(named).collect()
    assert len(kept) == 40 and sum(r["source"] == "shared" for r in kept) >= 8


def test_rerank_cutoff(spark):
    rows = [(1, f"d{k}", k, r) for k, r in enumerate([0.5, 0.435546875, 0.4355, 0.9, 0.5] + [0.6] * 8)]
    found = fusion.rerank_cutoff(spark.createDataFrame(rows, "query_id long, id string, index long, relevance double")).orderBy("rank").collect()
    assert [r["id"] for r in found] == ["d3", *[f"d{k}" for k in range(5, 12)]]
    assert [r["score"] for r in found] == [round(1 / k, 6) for k in range(1, 9)]


def test_baseline_by_hand(spark):
    rows = [(1, "alpha", 1, "one.md", "alpha", "alpha", 1.0), (1, "alpha", 2, "one.md", "", "beta", 0.9), (1, "alpha", 3, "two.md", "", "none", 0.1)]
    df = spark.createDataFrame(rows, "query_id long, query string, id long, source string, heading string, text string, cosine double")
    found = baseline.rank_baseline(df).collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 0.99)]


def test_excerpts_by_hand():
    suffix = "😀 " * 230 + "\nżółw refreshToken"
    assert best_window(suffix, {"refreshtoken": 1.0, "refresh": 1.0, "token": 1.0}) == (len(suffix) - 400, len(suffix))
    common = "common " * 60 + " " * 401 + "rare"
    assert best_window(common, {"common": 0.1, "rare": 1.0})[0] == len(common) - 400
    twice = " " * 500 + "needle " + " " * 600 + "needle"
    assert best_window(twice, {"needle": 1.0}) == (106, 506)
    assert best_window("no hit", {"x": 1.0}) == (0, 6)
    assert best_window("x" * 500, {"x" * 500: 1.0}) == (0, 400)


def test_excerpts_against_every_window():
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice(["aa", "bB", "c_d", " ", " ", "\n", "e"]) for _ in range(rnd.randint(0, 60)))
        size = rnd.randint(1, 30)
        weights = {t: rnd.choice([0.5, 1.0, 2.0]) for t in ("aa", "b", "bb", "c", "d", "c_d") if rnd.random() < 0.6}
        found = occurrences(text)
        width = min(size, len(text))
        value = lambda p: sum(weights[t] for t in {t for t, a, b in found if t in weights and a >= p and b <= p + width})
        best = max((value(p) for p in range(len(text) - width + 1)), default=0)
        at, end = best_window(text, weights, size)
        assert end - at == width and value(at) == pytest.approx(best)


def test_excerpt_rows(spark):
    df = spark.createDataFrame([(1, "a needle " + "x" * 500, {"needle": 1.0}), (2, None, None)], "id long, text string, weights map<string,double>")
    found = {r["id"]: r for r in excerpt.excerpts(df).collect()}
    assert found[1]["snippet"].startswith("a needle") and found[1]["snippet"].endswith("…") and found[2]["snippet"] == ""


def wordy(rnd, n):
    pieces = ["aa", "bB", "c_d", " ", " ", "\n", "e", "HTTPServer2Go", "żółwŁ", "😀", "x.y/Zz", "日本", "__", "Aa-", "é:"]
    return "".join(rnd.choice(pieces) for _ in range(n))


def test_occurrences_are_those_of_the_plain_form(spark):
    rnd = random.Random(11)
    texts = [None, "", "!?", "a", "a.b_c" * 300, "x" * 5000, *[wordy(rnd, rnd.randint(0, 80)) for _ in range(150)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = {k: set() for k in range(len(texts))}
    for r in excerpt.occurrences(rows).collect():
        found[r["key"]].add((r["term"], r["start"], r["end"]))
    for k, text in enumerate(texts):
        assert found[k] == set(occurrences(text or "")), text


def test_excerpts_are_those_of_the_plain_form(spark):
    rnd, rows = random.Random(12), []
    terms = ["aa", "b", "bb", "c", "d", "c_d", "http", "server2", "go", "żółw", "ł", "x.y/zz", "zz", "日本", "missing"]
    for k in range(250):
        weights = {t: rnd.choice([0.5, 1.0, 2.0, 3.25]) for t in terms if rnd.random() < 0.5}
        rows.append((k, rnd.choice([None, "", wordy(rnd, rnd.randint(0, 60)), wordy(rnd, 400)]), weights or None))
    rows += [(250, "needle " * 30_000, {"needle": 1.0}), (251, "a." * 20_000 + "Needle", {"needle": 1.0}), (252, " " * 500 + "aa", {"aa": 0.0, "b": None})]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id long, text string, weights map<string,double>").withColumn("key", F.lit("k")).withColumn("a b.c", F.lit(1))
    for size in (7, 30, 400):
        out = excerpt.excerpts(df, size)
        assert out.columns == ["id", "key", "a b.c", "start", "end", "snippet"]
        found = sorted((r["id"], r["start"], r["end"], r["snippet"]) for r in out.collect())
        want = []
        for k, text, weights in rows:
            text = text or ""
            a, b = best_window(text, {t: w for t, w in (weights or {}).items() if w}, size)
            want.append((k, a, b, ("…" if a else "") + text[a:b] + ("…" if b < len(text) else "")))
        assert found == sorted(want)
    assert excerpt.excerpts(df.limit(0)).count() == 0


def test_scores_of_a_saved_index_are_summed_without_a_shuffle_by_passage(spark, data):
    from gleaner.operators import lexical
    from gleaner.plans import queries as library

    built = lexical.build_index(library.passages(spark, data), "doc_id", {"body": "text", "path": "path"})
    terms = lexical.query_terms(library.questions(spark, data), "item_id", "query")
    saved = lexical.bm25(built.saved(), terms)
    plan = saved._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, lexical.bm25(built, terms).collect()))


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TEXT", 1000)
    df = spark.createDataFrame([(k, "aa bb " * 50) for k in range(60)], "id long, body string")
    assert lexical.postings(df, "id", "body").rdd.getNumPartitions() == 18
    saved = lexical.build_index(df, "id", {"body": "body"}).saved()
    assert saved.parts == 18 and saved.postings.inputFiles()
    assert {(r["id"], r["term"], r["tf"], r["length"]) for r in saved.postings.collect()} == {(k, t, 50, 100) for k in range(60) for t in ("aa", "bb")}


def test_products_are_cut_into_slices_of_scores(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SCORES", 50)
    rnd = random.Random(3)
    rows = [(k, [float(rnd.randint(-1, 1)), float(rnd.randint(-1, 1)), 1.0]) for k in range(60)]  # many equal scores
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = similarity.cosine_top(df.where("id % 6 = 0"), df, 7).collect()
    cos = lambda v, w: round(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)), 6)
    for q, v in rows[::6]:
        want = sorted((-cos(v, w), k) for k, w in rows)[:7]
        assert [(-r["score"], r["id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_queries_deal_texts_by_their_size(spark, tmp_path, monkeypatch):
    from gleaner.plans import queries as library

    monkeypatch.setattr(lexical, "TEXT", 1000)
    spark.createDataFrame([(k, "aa bb " * 50, "s") for k in range(60)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = library.token_frequencies(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().toString()) and ", 18), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, found.collect())) == [("aa", 3000, 60), ("bb", 3000, 60)]
    built = library._index(spark, str(tmp_path))
    assert built.parts > 18 and {r["total_length"] for r in built.stats.where("field = 'body'").collect()} == {6000}


@pytest.mark.parametrize(
    "name",
    ["expanded_fusion", "expanded_fusion_batch", "ranked_metrics_whole", "rrf_fusion_whole", "unit_novelty_ndcg_whole", "protected_fusion_40_whole", "ablation_views", "bm25_topk", "lexical_lengths"],
)
def test_every_query_of_the_index_deals_texts_by_their_size(spark, data, monkeypatch, name):
    from gleaner.plans import queries as library

    class Built(Exception):
        pass

    def saved(self, path=None):
        raise Built([(self.parts, field._jdf.queryExecution().toString()) for field in self.fields])

    monkeypatch.setattr(lexical, "TEXT", 1000)
    monkeypatch.setattr(lexical.LexicalIndex, "saved", saved)
    with pytest.raises(Built) as found:
        getattr(library, name)(spark, data)
    (fields,) = found.value.args
    size = library.passages(spark, data).selectExpr("sum(octet_length(text)) + sum(octet_length(path))").first()[0]
    assert len(fields) == 2 and all(parts == -(-size // 1000) and f", {parts}), REPARTITION_BY_NUM" in plan for parts, plan in fields)


@pytest.mark.parametrize("held, most", [(1 << 21, 1 << 20), (40, 1 << 20), (1 << 21, 5)])
def test_best_of_a_batch_are_those_of_all_scores(spark, monkeypatch, held, most):
    """Sums in matrices of any size give the rows that all scores give, ties by id; larger batches are joined."""
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(rnd.choices(words, range(25, 0, -1), k=rnd.randint(0, 12))), f"a/{k % 7}/w{k % 3}.md") for k in range(300)]
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(60)] + [(400, None, "none.md")]
    index = lexical.build_index(spark.createDataFrame(rows, "id long, body string, path string"), "id", {"body": "body", "path": "path"}).saved()
    asked = spark.createDataFrame([(9 * q, " ".join(rnd.sample(words + ["nowhere"], rnd.randint(1, 8)))) for q in range(30)] + [(1000, ""), (1001, "nowhere")], "id long, text string")
    terms = lexical.query_terms(asked, "id", "text")
    want = lexical.top(lexical.bm25(index, terms), 10).collect()
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "ASKED", most)
    assert sorted(lexical.bm25_top(index, terms, 10).collect()) == sorted(want) and len(want) > 200
    assert lexical.bm25_top(index, terms.where("query_id > 999"), 10).count() == 0


def test_terms_of_a_text_are_those_of_its_matches(spark):
    """Texts that are told to need no splitting give what splitting every match gives."""
    texts = ["Plain words. Here, and 12 there", "a-b c", "getUser", "HTTPServer", "x. Y", "_a B_", "a_ b", "q@", "ÄÖ aÄ", "x:/ y", "İx ß", "", "A"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    split = F.flatten(F.transform(text.matches(F.col("t")), text.match_terms))
    assert all(r["a"] == r["b"] for r in df.select(text.terms(F.col("t")).alias("a"), split.alias("b")).collect())
