import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.session import materialise
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_simhash import similar_brute
from tests.llm.texts import awkward, cut_brute, order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def stages(spark, docs):
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], ""), name))
    return seen


def held_against_brute_force(seen, missed):
    """``missed``: the share of near copies that the search for candidates may miss."""
    docs, language, exact, near, cut, packed = seen
    for df in (language, exact, near, cut):
        assert df.dtypes == docs.dtypes
    assert order(pairs(language)) == order((d, t) for d, t in pairs(docs) if any(c.isalpha() for c in t or ""))
    rows = pairs(language)
    lower = lambda t: hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()).hexdigest()
    assert order((d, lower(t)) for d, t in pairs(exact)) == order((d, h) for d, _, _, kept, h in exact_brute(rows) if kept)
    rows = pairs(exact)
    root = similar_brute(rows)
    stay = {d for d, _ in pairs(near)}
    assert order(pairs(near)) == order((d, t) for d, t in rows if d in stay)
    assert all(d in stay for d, r in root.items() if d == r) and (None in stay or all(d is not None for d, _ in rows))
    copies = [d for d, r in root.items() if d != r]
    assert sum(d in stay for d in copies) <= missed * len(copies)
    rows = pairs(near)
    assert order(pairs(cut)) == order((d, t if not n else kept) for (d, t), (_, _, n, kept) in zip(rows, cut_brute(rows, 13)))
    places = defaultdict(list)
    for r in packed.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert order({r["doc_id"] for r in packed.collect()}) == order({d for d, _ in pairs(cut)})
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_awkward_documents(spark):
    docs = spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, "s", len(t or "")) for d, t in awkward()], SCHEMA)
    held_against_brute_force(stages(spark, docs), 0.1)


def test_columns_with_odd_and_clashing_names(spark):
    """Columns beside those of documents go along, whatever their names."""
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in awkward(5)], SCHEMA)
    for name in ("my col", "a.b", "c-d", "row", "kept", "digest", "part", "slot", "block", "payload", "size", "key", "tag", "fp", "gone_id", "d_id", "length"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    seen = stages(spark, docs)
    held_against_brute_force(seen, 0.1)
    for df in seen[1:-1]:
        assert df.columns == docs.columns
        assert all(r["my col"] == f"my col: {'none' if r['doc_id'] is None else r['doc_id']}" and r["a.b"][:4] == "a.b:" and r["key"][:4] == "key:" for r in df.collect())


def test_given_documents(spark, data):
    seen = stages(spark, spark.read.parquet(f"{data}/documents.parquet"))
    held_against_brute_force(seen, 0.1)
    assert seen[2].count() < seen[1].count()


def test_empty_table(spark):
    assert stages(spark, spark.createDataFrame([], SCHEMA))[-1].count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
