import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm.queries import op8_sharding
from gleaner.llm.sharding import SLACK, first_map, load_map, rebalance, save_map, shard_documents, slot_sizes, versions
from gleaner.session import shared_path
from tests.llm.texts import awkward, frame, order


def check(found, rows, shards):
    assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == order((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    places = defaultdict(list)
    for r in found:
        assert 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_awkward_rows(spark):
    rows = awkward()
    found = shard_documents(frame(spark, rows), 5, shared_path(spark, "m"), 64).collect()
    check(found, rows, 5)
    assert all(len({r["shard"] for r in found if r["virtual_slot"] == v}) == 1 for v in {r["virtual_slot"] for r in found})


def greedy(rows, shards, slots, slot_of):
    """Largest slot first to the least loaded shard; slots in order of bytes, then number."""
    sizes = Counter()
    for d, t in rows:
        sizes[slot_of[d]] += len((t or "").encode()) + 8
    loads, out = [0] * shards, {}
    for v, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        at = loads.index(min(loads))
        out[v] = at
        loads[at] += n
    return out


def test_slots_are_dealt_as_a_plain_greedy_deals_them(spark):
    rows = [(k, "x" * (k * 7919 % 400)) for k in range(700)]
    found = shard_documents(frame(spark, rows), 7, shared_path(spark, "m"), 128).collect()
    want = greedy(rows, 7, 128, {r["doc_id"]: r["virtual_slot"] for r in found})
    assert all(r["shard"] == want[r["virtual_slot"]] for r in found)


def test_a_second_run_uses_the_stored_map(spark):
    path = shared_path(spark, "m")
    rows = awkward() + [(None, f"no id {k}") for k in range(500)] + [(77, "many rows of one id")] * 300
    docs = frame(spark, rows)

    def run(shards):
        return {(r["doc_id"], r["text_crc32"], r["virtual_slot"]): (r["shard"], r["map_version"]) for r in shard_documents(docs, shards, path, 64).where("doc_id is not null").collect()}

    first = run(5)
    found = shard_documents(docs, 5, path, 64).collect()
    check(found, rows, 5)
    assert {r["map_version"] for r in found} == {1} and run(5) == first
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 5
    grown = run(6)
    assert {v for _, v in grown.values()} == {2} and {s for s, _ in grown.values()} == set(range(6))
    stay = sum(first[k][0] == grown[k][0] for k in first)
    assert stay > 0.6 * len(first)
    assert run(6) == grown and {r["version"] for r in versions(spark, path).collect()} == {1, 2}
    check(shard_documents(docs, 6, path, 64).collect(), rows, 6)


def test_a_stored_version_is_not_written_twice(spark):
    path = shared_path(spark, "m")
    sizes = spark.createDataFrame([(0, 5, 1), (1, 7, 1)], "virtual_slot int, bytes long, records long")
    save_map(first_map(sizes, 2), path)
    with pytest.raises(ValueError, match="already"):
        save_map(first_map(sizes, 2), path)
    assert load_map(spark, path).count() == 2


def test_new_slots_make_a_new_version(spark):
    path = shared_path(spark, "m")
    shard_documents(frame(spark, [(k, "a") for k in range(20)]), 3, path, 512).collect()
    rows = [(k, "a") for k in range(2000)]
    found = shard_documents(frame(spark, rows), 3, path, 512).collect()
    check(found, rows, 3)
    assert {r["map_version"] for r in found} == {2}


def test_bytes_are_nearly_equal(spark):
    rows = [(k, "x" * (k * 7919 % 400)) for k in range(6000)]
    found = shard_documents(frame(spark, rows), 24, shared_path(spark, "m")).collect()
    check(found, rows, 24)
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 24
    assert max(loads.values()) < 1.01 * mean and min(loads.values()) > 0.99 * mean


def loads_of(found):
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    return loads


def test_a_map_that_has_become_uneven_is_rebalanced(spark):
    """Texts of a second batch grow by their slot, so that the stored map no longer fits."""
    path, rnd = shared_path(spark, "m"), random.Random(3)
    first = [(k, "x" * rnd.randint(50, 400)) for k in range(3000)]
    before = shard_documents(frame(spark, first), 6, path, 128).collect()
    slot_of = {r["doc_id"]: r["virtual_slot"] for r in before}
    heavy = {v for v in range(128) if v % 5 == 0}
    second = [(k, t * (6 if slot_of[k] in heavy else 1)) for k, t in first]
    found = shard_documents(frame(spark, second), 6, path, 128).collect()
    check(found, second, 6)
    fresh = shard_documents(frame(spark, second), 6, shared_path(spark, "m"), 128).collect()
    assert {r["map_version"] for r in found} == {2}
    assert max(loads_of(found).values()) <= (1 + SLACK) * max(loads_of(fresh).values())
    old, new, anew = ({r["virtual_slot"]: r["shard"] for r in x} for x in (before, found, fresh))
    assert sum(old[v] != new[v] for v in old) < sum(old[v] != anew[v] for v in old)
    again = shard_documents(frame(spark, second), 6, path, 128).collect()
    assert order(again) == order(found) and {r["version"] for r in versions(spark, path).collect()} == {1, 2}


def test_what_cannot_be_evened_makes_no_new_version(spark):
    """More shards than filled slots, and a slot larger than a shard's share."""
    path = shared_path(spark, "m")
    rows = [(1, "x" * 9000), (2, "a"), (3, "b")]
    for _ in range(3):
        found = shard_documents(frame(spark, rows), 7, path, 64).collect()
        check(found, rows, 7)
        assert {r["map_version"] for r in found} == {1}


def test_a_folder_that_is_no_map_is_an_error(spark, tmp_path):
    (tmp_path / "version=1").mkdir()
    (tmp_path / "version=1" / "part-0.parquet").write_text("this is no table")
    with pytest.raises(Exception, match="(?i)parquet"):
        shard_documents(frame(spark, [(1, "a")]), 3, str(tmp_path), 64).collect()


def test_the_query_and_its_versions_by_a_plain_greedy(spark, tmp_path):
    """``op8_sharding`` over two batches with one stored map, against a plain version of each."""
    path, rnd, shard = shared_path(spark, "m"), random.Random(8), {}
    for batch, (n, longest) in enumerate([(4000, 300), (5000, 300), (5000, 300)]):
        rows = [(k, None if k % 97 == 0 else "é" * rnd.randint(0, longest)) for k in range(n)] if batch < 2 else rows
        where = tmp_path / f"batch{batch}"
        frame(spark, rows).write.parquet(str(where / "documents.parquet"))
        found = op8_sharding(spark, str(where), path).collect()
        check(found, rows, 24)
        virtual = {d: xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) % 4096 for d, _ in rows}
        assert all(r["virtual_slot"] == virtual[r["doc_id"]] and r["law"] == "bytes" and r["grown_shard"] is None for r in found)
        if batch == 0:
            want = greedy(rows, 24, 4096, virtual)
            assert all(r["shard"] == want[r["virtual_slot"]] for r in found)
        assert {r["map_version"] for r in found} == {min(batch, 1) + 1}
        loads = loads_of(found)
        assert max(loads.values()) < (1 + SLACK) * sum(loads.values()) / 24
        now = {r["doc_id"]: r["shard"] for r in found}
        if batch == 1:
            assert sum(shard[d] == now[d] for d in shard) > 0.7 * len(shard)
        if batch == 2:
            assert now == shard
        shard = now


def test_rebalancing_writes_a_version_that_moves_little(spark):
    sizes = spark.range(512).select(F.col("id").cast("int").alias("virtual_slot"), (100 + F.col("id") % 7).alias("size"))
    sizes = slot_sizes(sizes)
    path = shared_path(spark, "m")
    save_map(first_map(sizes, 8), path)
    save_map(rebalance(load_map(spark, path, 1), sizes, 9), path)
    old, new = ({r["virtual_slot"]: r["shard"] for r in load_map(spark, path, v).collect()} for v in (1, 2))
    assert set(old) == set(new) and set(old.values()) == set(range(8)) and set(new.values()) == set(range(9))
    moved = sum(old[k] != new[k] for k in old)
    assert 512 / 9 * 0.8 < moved < 512 / 9 * 1.4
    fewer = {r["virtual_slot"]: r["shard"] for r in rebalance(load_map(spark, path, 2), sizes, 8).collect()}
    assert set(fewer.values()) == set(range(8))


def test_no_python_in_the_plan(spark):
    plan = shard_documents(frame(spark, awkward()), 5, shared_path(spark, "m"), 64)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert shard_documents(frame(spark, []), 5, shared_path(spark, "m"), 64).count() == 0
