import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm.exact_dedup import DigestIndex, deduplicate, keep_first
from gleaner.session import shared_path
from tests.llm.texts import awkward, frame, order

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(d)
    out, done = [], set()
    for d, t in rows:
        h = hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
        keep = max((x for x in groups[h] if x is not None), default=None)
        kept = d == keep and (h, d) not in done
        done.add((h, d))
        out.append((d, keep, len(groups[h]), kept, h))
    return out


def test_decisions_match_brute_force(spark):
    rows = awkward()
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    found = deduplicate(frame(spark, rows), index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert order(map(tuple, found)) == order(brute(rows))


def test_one_row_of_each_text_goes_on_with_all_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = keep_first(docs, DigestIndex(spark, shared_path(spark, "i"), 4))
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert order([(d, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for d, t in kept]) == order([(d, h) for d, _, _, k, h in brute(rows) if k])


def test_a_later_batch_is_held_against_the_index(spark):
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    first = deduplicate(frame(spark, [(1, "a"), (2, "A"), (3, "b")]), index).collect()
    assert {r["doc_id"] for r in first if r["kept"]} == {2, 3}
    later = deduplicate(frame(spark, [(10, "a"), (11, "c"), (12, "C"), (13, "b")]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later} == {(10, 2, False), (11, 12, False), (12, 12, True), (13, 3, False)}
    again = DigestIndex(spark, index.path, 4)
    assert again.table().count() == 3
    assert index.compact().table().count() == 3


def decisions(found):
    return order((r["doc_id"], r["keep_id"], r["kept"]) for r in found.collect())


def test_copies_of_indexed_texts_go_whatever_their_ids(spark):
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    deduplicate(frame(spark, [(5, "b"), (None, "a")]), index).collect()
    assert decisions(deduplicate(frame(spark, [(5, "b"), (None, "a"), (6, "c")]), index)) == order([(5, 5, False), (None, None, False), (6, 6, True)])


def test_a_retry_of_a_batch_decides_alike(spark):
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    deduplicate(frame(spark, [(1, "a")]), index, "first")
    rows = frame(spark, [(2, "a"), (3, "b"), (4, "B"), (None, "c")])
    want = order([(2, 1, False), (3, 4, False), (4, 4, True), (None, None, True)])
    assert decisions(deduplicate(rows, index, "second")) == want
    assert decisions(deduplicate(rows, index, "second")) == want  # all of it was there already
    assert decisions(deduplicate(frame(spark, [(1, "a")]), index, "first")) == [(1, 1, True)]
    # a run that had brought a part of its batch only
    half = DigestIndex(spark, shared_path(spark, "i"), 4)
    deduplicate(frame(spark, [(1, "a")]), half, "first")
    deduplicate(frame(spark, [(4, "B")]), half, "second")
    assert decisions(deduplicate(rows, half, "second")) == want and half.table().count() == 3


def test_hot_groups(spark):
    rows = [(k, "same") for k in range(3000)] + [(k, f"t{k // 2}") for k in range(3000, 6000)] + [(7, "same")] * 50
    found = deduplicate(frame(spark, rows), DigestIndex(spark, shared_path(spark, "i"), 4)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert order(map(tuple, found)) == order(brute(rows))


def test_an_index_keeps_its_buckets(spark):
    path = shared_path(spark, "i")
    index = DigestIndex(spark, path, 4)
    deduplicate(frame(spark, [(1, "a")]), index)
    index.close()
    assert DigestIndex(spark, path).buckets == 4 and DigestIndex(spark, path).table().count() == 1
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, path, 8)


def test_column_names(spark):
    docs = frame(spark, [(1, "a"), (2, "A"), (3, "b"), (3, "a"), (4, "b"), (4, "c")]).withColumn("my col", F.lit(1)).withColumn("a.b", F.lit("x"))
    out = keep_first(docs, DigestIndex(spark, shared_path(spark, "i"), 4))
    assert out.columns == docs.columns and order((r["doc_id"], r["text"]) for r in out.collect()) == order([(3, "a"), (4, "b"), (4, "c")])


def test_the_index_side_of_the_anti_join_is_not_exchanged(spark):
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    deduplicate(frame(spark, awkward()), index)
    new = spark.range(100).selectExpr("cast(id as string) as digest", "id as keep_id")
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1, plan


def test_empty_table(spark):
    index = DigestIndex(spark, shared_path(spark, "i"), 4)
    assert deduplicate(frame(spark, []), index).count() == 0
    assert index.table().count() == 0
    assert keep_first(frame(spark, []), index).count() == 0
