import pytest

from gleaner.errors import EngineError
from gleaner.plans.index import VECTORS, Index, prepare, receipts, vectors
from gleaner.plans.versions import latest, put, swap
from gleaner.plans.search import search
from gleaner.sources.limits import Passing
from gleaner.sources.providers import HashEmbedding, NoExpansion, OverlapRerank
from gleaner.streaming.prepare import prepare_stream

MODEL = HashEmbedding(32)


class Variants:
    def expand(self, query):
        return {"lex": ["garbage collection of vectors"], "vec": [], "hyde": []} if "remove" in query else {"lex": [], "vec": [], "hyde": []}


def sources(spark, **texts):
    return spark.createDataFrame([(f".agent/knowledge/{k}.md", v) for k, v in texts.items()], "source string, text string")


TEXTS = {"auth": "# Auth\n\nTokens are refreshed by refreshToken every hour.\n\n## Errors\n\nE_AUTH_403 means the token is not valid.", "gc": "# Index\n\nGarbage collection of vectors deletes what no passage uses.", "empty": "", "blank": " \n\n"}


def test_life_of_an_index(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(EngineError):
        Index(spark, root)
    first = prepare(spark, sources(spark, **TEXTS), root, MODEL)
    assert first["embedded"] == first["inputs"] == first["passages"] >= 3
    again = prepare(spark, sources(spark, **TEXTS), root, MODEL)
    assert again["embedded"] == 0 and again["passages"] == first["passages"]
    changed = prepare(spark, sources(spark, **{**TEXTS, "gc": "# Index\n\nOther text."}), root, MODEL)
    assert changed["embedded"] == 1
    index = Index(spark, root, MODEL)
    assert index.generation == changed["generation"] and index.status()["missing_vectors"] == 0
    with pytest.raises(EngineError):
        Index(spark, root, HashEmbedding(16))
    assert index.collect_garbage() == {"removed": 1, "retained": changed["inputs"]}
    assert index.status()["missing_vectors"] == 0
    with pytest.raises(Exception):
        prepare(spark, sources(spark, a="x").unionByName(sources(spark, a="x")), root, MODEL)
    assert Index(spark, root).generation == changed["generation"]


def test_search(spark, tmp_path):
    root = str(tmp_path / "index")
    prepare(spark, sources(spark, **TEXTS), root, MODEL)
    queries = spark.createDataFrame([(1, "what does E_AUTH_403 mean"), (2, "remove unused vectors"), (3, "refreshToken every hour")], "query_id long, query string")
    found = search(spark, Index(spark, root), queries, MODEL, Variants(), OverlapRerank()).orderBy("query_id", "rank").collect()
    best = {r["query_id"]: r for r in reversed(found)}
    assert best[3]["source"].endswith("auth.md") and "refreshToken" in best[3]["snippet"] and best[3]["rank"] == 1 and best[3]["score"] == 1.0
    text = TEXTS["auth"]
    assert text[best[3]["start"] : best[3]["end"]] == best[3]["snippet"].strip("…")
    none = search(spark, Index(spark, root), queries.limit(0), MODEL, NoExpansion(), OverlapRerank())
    assert none.count() == 0


def test_stream(spark, tmp_path):
    root, inbox = str(tmp_path / "index"), tmp_path / "inbox"
    inbox.mkdir()
    stream = lambda: spark.readStream.schema("source string, text string, version long").json(str(inbox))
    (inbox / "1.json").write_text('{"source": ".agent/knowledge/a.md", "text": "alpha", "version": 1}\n{"source": ".agent/knowledge/b.md", "text": "beta", "version": 1}\n')
    prepare_stream(spark, stream(), root, MODEL, str(tmp_path / "ck")).awaitTermination()
    assert Index(spark, root).status()["passages"] == 2
    (inbox / "2.json").write_text('{"source": ".agent/knowledge/a.md", "text": "gamma", "version": 2}\n{"source": ".agent/knowledge/b.md", "text": null, "version": 2}\n')
    prepare_stream(spark, stream(), root, MODEL, str(tmp_path / "ck")).awaitTermination()
    assert [r["text"] for r in Index(spark, root).passages().collect()] == ["gamma"]


def test_a_broken_index_is_not_opened(spark, tmp_path):
    root = str(tmp_path / "index")
    made = prepare(spark, sources(spark, **TEXTS), root, MODEL)
    assert Index(spark, root, MODEL, checked=True).generation == made["generation"]
    at = f"{root}/generations/{made['generation']}/lengths"
    spark.read.parquet(at).limit(1).write.mode("append").parquet(at)
    with pytest.raises(EngineError, match="INDEX_INVALID"):
        Index(spark, root, MODEL, checked=True)


def test_garbage_collection_leaves_the_old_folder_to_its_readers(spark, tmp_path):
    root = str(tmp_path / "index")
    prepare(spark, sources(spark, **TEXTS), root, MODEL)
    prepare(spark, sources(spark, gc=TEXTS["gc"]), root, MODEL)
    before = Index(spark, root, MODEL)
    every = before.vectors().count()
    gone = before.collect_garbage()
    after = Index(spark, root, MODEL)
    assert after.folder != before.folder and before.vectors().count() == every == gone["removed"] + gone["retained"]
    assert after.vectors().count() == gone["retained"] and after.status()["missing_vectors"] == 0
    assert prepare(spark, sources(spark, gc=TEXTS["gc"]), root, MODEL)["embedded"] == 0


class Failing:
    """Fails in a way that may pass, as often as told, in every process."""

    def __init__(self, times, model=MODEL):
        self.times, self.name, self.size, self.model = times, model.name, model.size, model

    def embed(self, texts):
        if self.times:
            self.times -= 1
            raise Passing("busy")
        return self.model.embed(texts)


def test_budgets_and_retries_hold_in_a_search(spark, tmp_path):
    root = str(tmp_path / "index")
    prepare(spark, sources(spark, **TEXTS), root, Failing(1))
    asked = spark.createDataFrame([(1, "tokens")], "query_id long, query string")
    run = lambda queries, model, seconds=30.0: search(spark, Index(spark, root), queries, model, NoExpansion(), OverlapRerank(), seconds=seconds).count()
    assert run(asked, Failing(1)) > 0
    with pytest.raises(Exception, match="EMBEDDING_FAILED"):
        run(asked, Failing(9), 1.5)
    with pytest.raises(Exception, match="QUERY_TOO_LARGE"):
        run(spark.createDataFrame([(1, "x" * 20_000)], asked.schema), MODEL)


def test_broken_receipts_are_embedded_again(spark, tmp_path):
    root = str(tmp_path / "index")
    prepare(spark, sources(spark, **TEXTS), root, MODEL)
    stored = spark.read.parquet(f"{root}/vectors").collect()
    broken = [stored[0].asDict() | {"norm": 7.0, "generation": "0"}, stored[1].asDict() | {"embedding": [0.0] * 32, "generation": "0"}, stored[2].asDict() | {"embedding": [1.0], "norm": 1.0, "generation": "0"}]
    names = list(broken[0])
    spark.createDataFrame([tuple(r[c] for c in names) for r in broken], VECTORS.replace(", ", ",")).select(*names).write.mode("append").parquet(f"{root}/vectors")
    found = {r["chunk_hash"]: r["embedding"] for r in Index(spark, root, MODEL).vectors().collect()}
    assert found == {r["chunk_hash"]: r["embedding"] for r in stored}  # older, but not sound
    other = str(tmp_path / "other")
    spark.createDataFrame([tuple(r[c] for c in names) for r in broken], VECTORS).write.parquet(f"{other}/vectors")
    made = prepare(spark, sources(spark, **TEXTS), other, MODEL)
    assert made["embedded"] == made["inputs"] and receipts(spark, other, Index(spark, other).profile).where("broken").count() == 3


def test_of_sound_receipts_the_oldest_counts(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [(f"m:2:b", "h", [x, 1.0], (x * x + 1) ** 0.5, g) for x, g in ((3.0, "b"), (2.0, "a"), (5.0, "c"), (4.0, "a"))]
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{root}/vectors")
    assert [r["embedding"] for r in vectors(spark, root, "m:2:b").collect()] == [[2.0, 1.0]]


def test_writers_lose_nothing_to_one_another(spark, tmp_path, monkeypatch):
    """Garbage that is collected while a generation is made, and a generation that is made while garbage is collected."""
    from gleaner.plans import index as module

    root = str(tmp_path / "index")
    prepare(spark, sources(spark, **TEXTS), root, MODEL)
    prepare(spark, sources(spark, gc=TEXTS["gc"]), root, MODEL)
    real, turns = module.swap, []

    def meanwhile(other):
        def swap(spark_, folder, build):
            def first(seen):
                made = build(seen)
                if not turns:
                    turns.append(1)
                    other()
                return made

            return real(spark_, folder, first)

        monkeypatch.setattr(module, "swap", swap)

    meanwhile(lambda: Index(spark, root, MODEL).collect_garbage())
    made = prepare(spark, sources(spark, **TEXTS, new="some new text"), root, MODEL)
    opened = Index(spark, root, MODEL)
    assert opened.generation == made["generation"] and opened.folder != "vectors" and opened.status()["missing_vectors"] == 0
    turns.clear()
    meanwhile(lambda: prepare(spark, sources(spark, late="text that comes late", **TEXTS), root, MODEL))
    opened.collect_garbage()
    opened = Index(spark, root, MODEL)
    assert opened.status() | {"profile": 0} == {"sources": 5, "passages": opened.passages().count(), "missing_vectors": 0, "profile": 0}
    assert opened.generation > made["generation"]


def test_versions(spark, tmp_path):
    at = str(tmp_path / "published")
    assert latest(spark, at) is None and put(spark, at, 0, {"a": 1}) == 1
    assert put(spark, at, 0, {"a": 2}) is None and put(spark, at, 1, {"a": 3}) == 2
    (tmp_path / "published" / "v000000000003.json").write_text('{"a"')  # its writer died
    assert latest(spark, at) == (2, {"a": 3}) and put(spark, at, 2, {"a": 4}) == 4 and latest(spark, at) == (4, {"a": 4})
    assert swap(spark, at, lambda seen: {"a": seen["a"] + 1}) == {"a": 5}
    with pytest.raises(EngineError, match="INDEX_BUSY"):
        swap(spark, at, lambda seen: put(spark, at, latest(spark, at)[0], {"a": 0}) and seen)
