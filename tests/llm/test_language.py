import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm.language import LEAST, SHARE, UNDETERMINED, LanguageFilters, detect_languages, fit, ngrams, portions, with_letters
from gleaner.llm.queries import op5_language
from tests.llm.texts import awkward, frame


def plain_ngrams(text, order=3):
    import unicodedata

    code, out = [0], []
    for c in (text or "").lower():
        if unicodedata.category(c)[0] == "L":
            code.append(ord(c))
        elif code[-1]:
            code.append(0)
    if code[-1]:
        code.append(0)
    for k in range(len(code) - order + 1):
        g = code[k : k + order]
        if all(g[1:-1]) and (g[0] or g[-1] or order == 3):
            out.append(tuple(g))
    return out


def test_ngrams_are_those_of_each_text_alone():
    texts = ["Ab cd", None, "", "1 2", "x", "naïve Ärger", "a1b", "日本語", "İstanbul", "end"]
    values, starts, letters = ngrams(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in (t or "").lower()) for t in texts]
    for k, t in enumerate(texts):
        want = [g for g in plain_ngrams(t) if g[1]]
        alone = ngrams([t])[0]
        assert len(want) == starts[k + 1] - starts[k], (t, want)
        assert values[starts[k] : starts[k + 1]].tolist() == alone.tolist()
        assert len(set(want)) == len(set(alone.tolist()))


def test_portions_have_the_ngrams_of_the_whole():
    texts = ["one two  three ", None, "", "x" * 50, " a b c d e f g h i j", "last words", "z "]
    for chars in (1, 3, 10, 1000):
        grams = {}
        for owners, parts in portions(texts, chars):
            values, starts, _ = ngrams(parts)
            for k, a, b in zip(owners, starts[:-1], starts[1:]):
                grams.setdefault(k, []).extend(values[a:b].tolist())
        assert {k: sorted(v) for k, v in grams.items()} == {k: sorted(ngrams([t])[0].tolist()) for k, t in enumerate(texts)}


def test_filters_return_all_languages_of_an_ngram():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    filters = LanguageFilters.build({"b": np.concatenate((b, a[:100])), "a": a})
    mask = filters.languages_of(a)
    assert filters.languages == ["a", "b"] and (mask & np.uint64(1)).all() and (mask[:100] == 3).all()
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    rate = filters.false_positives()
    for l in range(2):
        assert abs(((filters.languages_of(other) >> np.uint64(l)) & np.uint64(1)).mean() - rate[l]) < 0.01
    with pytest.raises(ValueError):
        LanguageFilters.build({str(k): a[:1] for k in range(65)})


def test_awkward_texts(spark):
    train = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5 + [(None, "en"), ("x", None), ("the", "en")])], "doc_id long, text string, lang string")
    filters = fit(train)
    rows = awkward() + [(700, "The hat"), (701, "und der Hut"), (702, "123 !?"), (703, "☃"), (704, "б")]
    found = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in detect_languages(frame(spark, rows), filters).select("row.doc_id", "row.text", "lang_pred", "score").collect()}
    assert len(found) == len(set(rows))
    for (_, t), (lang, score) in found.items():
        assert (lang == UNDETERMINED) == (not any(c.isalpha() for c in t or "")) and 0 <= score <= 1
    assert found[700, "The hat"][0] == "en" and found[701, "und der Hut"][0] == "de"
    assert detect_languages(frame(spark, []), filters).count() == 0
    assert detect_languages(frame(spark, rows), fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_bounded_sample(spark):
    train = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same old text").alias("text"), F.lit("en").alias("lang"))
    few, all_ = fit(train, rows=100), fit(train)
    assert few.languages == all_.languages == ["en"]


def test_held_out_accuracy(spark, data):
    found = op5_language(spark, data).where("held_out").join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_column_names(spark):
    docs = frame(spark, [(1, "der Hund"), (2, "1 2")]).withColumn("my col", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("c-d", F.array(F.lit(1)))
    out = detect_languages(docs, LanguageFilters.build({}))
    assert out.select("row.*").columns == docs.columns and out.count() == 2
    assert [(r["doc_id"], r["my col"], r["a.b"]) for r in with_letters(docs).collect()] == [(1, 1, "x")]


def plain_languages(rows):
    """``op5``'s answers by plain sets of n-grams: ``{doc_id: {lang: share of the text's n-grams}}``."""
    counts = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            counts[lang].update(plain_ngrams(text))
    rate = {l: {g: n / c.total() for g, n in c.items()} for l, c in counts.items()}
    top = defaultdict(float)
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    known = {l: {g for g, x in r.items() if counts[l][g] >= LEAST and x >= SHARE * top[g]} for l, r in rate.items()}
    out = {}
    for d, text, _ in rows:
        grams = plain_ngrams(text)
        out[d] = {l: sum(g in k for g in grams) / max(1, len(grams)) for l, k in known.items()}
    return out


def test_the_query_by_plain_sets(spark, data):
    """Every prediction and score of ``op5_language``; the filters' false positives, which are taken off, leave a little noise."""
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want, near = plain_languages(rows), 0
    found = {r["doc_id"]: r for r in op5_language(spark, data).collect()}
    assert found.keys() == want.keys()
    for d, text, _ in rows:
        r, shares = found[d], want[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        if not any(c.isalpha() for c in (text or "").lower()):
            assert (r["lang_pred"], r["score"]) == (UNDETERMINED, 0.0)
            continue
        noise = 0.01 + 0.5 / np.sqrt(max(1, len(plain_ngrams(text))))
        assert abs(r["score"] - shares[r["lang_pred"]]) < noise, (d, r, shares)
        assert shares[r["lang_pred"]] > max(shares.values()) - noise, (d, r, shares)
        near += r["lang_pred"] != max(sorted(shares), key=shares.get)
    assert near <= 0.01 * len(rows)
