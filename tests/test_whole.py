"""Queries that cover whole texts, against brute force on texts beyond the bounds of the cut ones."""

import pytest

from gleaner.plans import queries as library


@pytest.fixture
def long_texts(spark, tmp_path):
    rows = [(k, "x" * n, "s") for k, n in enumerate((0, 499, 500, 9_000, 12_000, 30_500, 128_657))]
    spark.createDataFrame([*rows, (99, None, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


@pytest.mark.parametrize("name", ["evidence_containment_whole", "span_overlap_join_whole"])
def test_spans_of_whole_texts(spark, long_texts, name):
    path, rows = long_texts
    want = []
    for d, text, _ in rows:
        for k in range(3):
            s = len(text) * k // 3
            for j in range(len(text) // 500 + 1):
                n = j * 500
                if (s <= n and s + 400 >= n + 60) if "containment" in name else (s < n + 60 and n < s + 400):
                    want.append((d, k, j))
    assert any(j > 19 for _, _, j in want)
    assert sorted(map(tuple, library.queries()[name](spark, path).collect())) == sorted(want)


def test_words_beyond_the_fifth_are_asked(spark, tmp_path):
    spark.createDataFrame([(k, f"plain filler text number{k}", "s") for k in range(20)] + [(20, "filler and then zanzibar at the end", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "one two three four five six zanzibar", None)], "item_id long, text string, x string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = library.bm25_fielded_batch_whole(spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["doc_id"]) for r in found] == [(3, 20)]
    assert [(r["item_id"], r["doc_id"]) for r in library.best_window_excerpt(spark, str(tmp_path)).collect()] == [(3, 20)]
    assert [(r["item_id"], r["doc_id"]) for r in library.expanded_fusion_batch(spark, str(tmp_path)).collect()] == [(3, 20)]


def test_evidence_that_retrieval_missed_counts(spark, tmp_path):
    spark.createDataFrame([(3, "zanzibar", "s"), (43, "elsewhere", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "zanzibar")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(3, 1, 0), (43, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r["span_recall8"] for r in library.ranked_metrics_whole(spark, str(tmp_path)).collect()] == [0.5]
