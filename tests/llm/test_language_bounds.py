import random

import corpus_pipeline
from gleaner.llm.language import detect_languages, fit
from tests.llm.texts import order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["a clean text", None, "", "123 !?", "日本", "x", "another clean text"]


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, l, "s", 0) for k, (t, l) in enumerate(rows)], SCHEMA)
    found = corpus_pipeline.language_stage(spark, docs, "")
    assert found.dtypes == docs.dtypes
    return order((r["doc_id"], r["text"]) for r in found.collect())


def test_stage_without_learned_languages(spark):
    want = order((k, t) for k, t in enumerate(TEXTS) if any(map(str.isalpha, t or "")))
    assert kept(spark, [(t, None) for t in TEXTS]) == want
    assert kept(spark, [(t, f"l{k}") for k, t in enumerate(TEXTS)]) == want  # no trigram occurs often enough


def test_more_than_64_languages(spark):
    rnd = random.Random(7)
    words = {f"l{k:03d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(150)}
    say = lambda l: " ".join(rnd.choice(words[l]) for _ in range(30))
    rows = [(n, say(l), l) for n, l in enumerate(list(words) * 3)]
    filters = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == sorted(words)
    asked = spark.createDataFrame([(k, say(l), l) for k, l in enumerate(words)], "doc_id long, text string, lang string")
    found = detect_languages(asked, filters).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 147
