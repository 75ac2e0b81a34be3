import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm.simhash import bit_majority, build_tree, fingerprint, hamming_edges, keep_dissimilar, keep_one, leaf_forest, near_duplicates, route, similar_links
from tests.llm.texts import awkward, components, frame, order


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for _, text in awkward():
        assert fingerprint(text) == plain(text)
    joined = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert fingerprint("A b  C") == joined % 2**64


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 255 * 64 + 7])
def test_bit_majority(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    assert bit_majority(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def clusters(seed=1, n=900):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    more = [base]
    for k in range(4):
        x = base.copy()
        for _ in range(k + 1):
            x ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        more.append(x)
    hub = np.array([int(base[0]) ^ 1 << i ^ 1 << j for i in range(40) for j in range(i)], np.uint64)
    return np.unique(np.concatenate([*more, hub]))


def links(fps):
    return [(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 3)]


@pytest.mark.parametrize("upper, depth", [(0, 0), (2, 2), (5, 5), (2, 6), (0, 4)])
def test_tree_finds_all_links(upper, depth):
    """Levels below the sampled ones have vantage points by a hash."""
    fps = clusters()
    nodes = build_tree(np.random.default_rng(2).choice(fps, 300), upper)
    leaves = {}
    for leaf, who, home in route(fps, nodes, 3, depth):
        leaves.setdefault(leaf, []).append((fps[who], np.full(len(who), home)))
    found = []
    for parts in leaves.values():
        src, dst = leaf_forest(np.concatenate([x for x, _ in parts]), np.concatenate([h for _, h in parts]), 3)
        found += zip(np.searchsorted(fps, src).tolist(), np.searchsorted(fps, dst).tolist())
    assert components(range(len(fps)), found) == components(range(len(fps)), links(fps))


def test_hashed_levels_keep_leaves_small():
    fps = np.random.default_rng(4).integers(0, 2**64, 60_000, dtype=np.uint64)
    homes = {}
    for leaf, who, home in route(fps, build_tree(fps[:200], 2), 3, 8):
        homes[leaf] = homes.get(leaf, 0) + len(who) * home
    assert sum(homes.values()) == len(fps) and max(homes.values()) < 5 * len(fps) / 256


@pytest.mark.parametrize("sample", [2000, 64])
def test_distributed_search(spark, sample):
    fps = clusters(3)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = hamming_edges(distinct, leaf=200, sample=sample).collect()
    number = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    assert components(range(len(fps)), [(number[r["src"]], number[r["dst"]]) for r in found]) == components(range(len(fps)), links(fps))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = components(range(len(rows)), near)
    first = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            first[root[k]] = min(first.get(root[k], d), d)
    return [(d, f"{fps[k]:016x}", first.get(root[k])) for k, (d, _) in enumerate(rows)]


def test_documents(spark):
    long = [f"t{k}" for k in range(400)]
    rows = awkward() + [(500 + k, " ".join([*long[:k], "changed", *long[k + 1 :]])) for k in range(0, 400, 40)]
    found = near_duplicates(frame(spark, rows)).collect()
    assert order(map(tuple, found)) == order(brute(rows))
    docs = frame(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    stay = {d for d, _, c in brute(rows) if d is None or d == c}
    assert order(r["doc_id"] for r in kept.collect()) == order(d for d, _ in rows if d in stay)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    assert keep_one(frame(spark, [])).count() == 0


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def similar_brute(rows):
    """Smallest id that each id reaches by similar texts; rows without an id are left out."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(frozenset(shingles(t)))
    every = sorted((d, x) for d, own in sets.items() for x in own)
    by_word = {}
    for k, (_, x) in enumerate(every):
        for s in x or {()}:
            by_word.setdefault(s, []).append(k)
    near = {(every[i][0], every[j][0]) for ks in by_word.values() for i in ks for j in ks if j < i and similar(every[i][1], every[j][1])}
    return components(sorted(sets), near)


def edited(rnd, words, share):
    return " ".join(w if rnd.random() > share else f"new{rnd.randint(0, 99999)}" for w in words)


def test_similar_documents(spark):
    """Copies with a few changed words are found, most of them at the threshold, and nothing else."""
    rnd = __import__("random").Random(11)
    vocabulary = [f"v{k}" for k in range(3000)] + ["the", "of", "and", "to"] * 300
    rows = [(k, None if k % 50 == 7 else "") for k in range(5, 300, 50)]
    for k in range(400):
        words = rnd.choices(vocabulary, k=rnd.choice([60, 150, 400, 1500]))
        rows.append((1000 + 10 * k, " ".join(words)))
        for c in range(rnd.choice([0, 0, 1, 3])):
            rows.append((1001 + 10 * k + c, edited(rnd, words, rnd.choice([0.005, 0.015, 0.02, 0.1, 0.4]))))
    rows += [(9, "same words in one order " * 40), (10, "order one in words same " * 40), (None, rows[20][1]), (rows[20][0], "another text of that id")]
    root = similar_brute(rows)
    found = {(r["a"], r["b"]) for r in similar_links(frame(spark, rows)).collect()}
    assert all(root[a] == root[b] for a, b in found) and (9, 10) not in found
    got = components(sorted(root), found)
    copies = [d for d in root if d != root[d]]
    assert len(copies) > 100 and sum(got[d] == root[d] for d in copies) > 0.95 * len(copies)
    docs = frame(spark, rows)
    out = keep_dissimilar(docs)
    assert out.columns == docs.columns
    assert order(r["doc_id"] for r in out.collect()) == order(d for d, _ in rows if d is None or d == got[d])


def test_similar_documents_of_a_large_group(spark, monkeypatch):
    from gleaner.llm import simhash

    monkeypatch.setattr(simhash, "PARTNERS", 16)
    monkeypatch.setattr(simhash, "CROWD", 40)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(300)] + [(k, "same text here again " * 9) for k in range(1000, 1300)]
    assert order(r["doc_id"] for r in keep_dissimilar(frame(spark, rows)).collect()) == [0, 1000]
    assert keep_dissimilar(frame(spark, [])).count() == 0


def test_recall_by_kind_of_edit(spark):
    """Copies with a similarity of just 0.8 and more are found, wherever they were edited."""
    from tests.llm.measure_similar import recall

    rnd = __import__("random").Random(4)
    texts = [" ".join(rnd.choices([f"v{k}" for k in range(800)] + ["the", "of"] * 60, k=rnd.choice([60, 200, 900]))) for _ in range(250)]
    found = recall(spark, texts)
    assert set(found) == {"scattered", "block 5 %", "block 10 %", "prefix 15 %", "first 10 % cut", "first 18 % cut"}
    assert all(n > 40 and share >= 0.93 for share, n in found.values()), found


def test_best_forest_has_the_nearest_of_each():
    import numpy as np

    from gleaner.llm.simhash import best_forest

    rnd = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        i, j = np.nonzero(rnd.random((n, n)) < 0.4)
        far = rnd.integers(0, 6, len(i))
        a, b = best_forest(n, i, j, far)
        assert components(range(n), zip(a.tolist(), b.tolist())) == components(range(n), zip(i.tolist(), j.tolist()))
        assert len(a) == n - len(set(components(range(n), zip(i.tolist(), j.tolist())).values()))
        least = {}
        for x, y, d in [*zip(i, j, far), *zip(j, i, far)]:
            if x != y:
                least[x] = min(least.get(x, 99), d)
        d_of = {}
        for x, y, d in zip(i.tolist(), j.tolist(), far.tolist()):
            d_of[x, y] = min(d_of.get((x, y), 99), d)
        got = {}
        for x, y in zip(a.tolist(), b.tolist()):
            d = d_of[x, y]
            got[x], got[y] = min(got.get(x, 99), d), min(got.get(y, 99), d)
        assert got == {int(k): int(v) for k, v in least.items()}


def test_no_candidate_is_left_unverified(spark, monkeypatch):
    """The forest of nearest pairs leaves candidates out, and crowds are dealt in parts; the second round has all that aren't joined."""
    import numpy as np

    from gleaner.llm import simhash

    ids, p, c = np.array([5, 6, 7, 8]), np.array([0, 1, 6, 0], np.uint64), np.zeros(4, np.uint64)
    nearest = {tuple(sorted(x)) for x in zip(*map(list, simhash.group_candidates(ids, p, c, 18, 28)))}
    assert (6, 7) not in nearest
    rest = simhash.other_candidates(ids, p, c, np.array([5, 6, 7, 5]), 18, 28)
    assert {tuple(sorted(map(int, x))) for x in zip(*rest)} == {(5, 6), (5, 7), (6, 7), (6, 8), (7, 8)}
    monkeypatch.setattr(simhash, "CROWD", 4)
    shared = spark.createDataFrame([(1, 11, d, 0, 0) for d in range(11)] + [(2, 2, d, 0, 0) for d in (20, 21)], "key long, n long, doc_id long, p long, c long")
    roots = spark.createDataFrame([(20, 20), (21, 20), (0, 0), (1, 0)], "node long, root long")
    met = {}
    for r in simhash._unjoined(shared, roots).collect():
        met.setdefault(r["shard"], set()).add(r["doc_id"])
    pairs = {(a, b) for own in met.values() for a in own for b in own if a < b}
    assert pairs == {(a, b) for a in range(11) for b in range(a + 1, 11)} and max(map(len, met.values())) < 11


def unlike_crowd(n=160, words=120):
    """Documents of one template, nearly all of them a little less similar than 0.8, and some that are links."""
    rnd = __import__("random").Random(8)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for d in range(n):
        own = list(base)
        for k in rnd.sample(range(words), 4):
            own[k] = f"own{d}x{k}"
        rows.append((d, " ".join(own)))
        if d % 20 == 3:
            own[-1] = "end"
            rows.append((1000 + d, " ".join(own)))
    return rows


def test_rows_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """Candidates that aren't links meet in groups, a row for each of their documents and keys, not for each pair."""
    from gleaner.llm import simhash
    from gleaner.session import materialise

    written = []

    def counted(df, tag):
        out = materialise(df, tag)
        written.append((out.count(), tag))
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    rows = unlike_crowd()
    root = similar_brute(rows)
    found = [(r["a"], r["b"]) for r in similar_links(frame(spark, rows)).collect()]
    sets = {d: shingles(t) for d, t in rows}
    assert all(similar(sets[a], sets[b]) for a, b in found)
    assert components(sorted(root), found) == root and 20 < len(set(root.values())) < len(rows)
    assert max(written)[0] <= 8 * len(rows), written


def test_groups_hold_all_candidates_that_are_not_joined():
    from gleaner.llm import simhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (30, 2), dtype=np.uint64)
    ids = rng.permutation(300).astype(np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, 6)) for _ in range(600)], np.uint64).reshape(300, 2)
    p, c = (base[np.arange(300) % 30] ^ flips).T.copy()
    root = rng.integers(0, 40, 300)
    number, who = simhash.other_groups(ids, p, c, root, 18, 28)
    of = dict(zip(who.tolist(), number.tolist()))
    pairs = set(zip(*(x.tolist() for x in simhash.other_candidates(ids, p, c, root, 18, 28))))
    assert pairs and set(of) == {x for pair in pairs for x in pair} and len(of) == len(who)
    joined = components(sorted(of), pairs)
    assert all((of[a] == of[b]) == (joined[a] == joined[b]) for a in of for b in of)
    turned = simhash.other_groups(ids[::-1], p[::-1].copy(), c[::-1].copy(), root[::-1], 18, 28)
    assert dict(zip(turned[1].tolist(), turned[0].tolist())) == of


def test_similar_pairs_span_what_all_comparisons_find():
    from gleaner.llm import simhash

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 40):
        sets = [np.unique(rng.integers(0, rng.choice([6, 12, 40]), rng.integers(0, 25))).astype(np.uint64) for _ in range(n)]
        links = [(a, b) for a in range(n) for b in range(a) if simhash.jaccard(sets[a], sets[b]) >= 0.6]
        i, j = (x.tolist() for x in simhash.similar_pairs(sets, 0.6))
        assert set(zip(j, i)) <= set(links)
        assert components(range(n), zip(i, j)) == components(range(n), links) and len(i) == n - len(set(components(range(n), links).values()))


def test_groups_of_large_sets_are_compared_in_parts(spark, monkeypatch):
    from gleaner.llm import simhash

    monkeypatch.setattr(simhash, "PACK", 4000)
    rows = unlike_crowd(60)
    root = similar_brute(rows)
    assert components(sorted(root), [(r["a"], r["b"]) for r in similar_links(frame(spark, rows)).collect()]) == root


def test_similar_documents_that_share_no_key_or_sketch(spark):
    """Copies a little above the threshold are all found, those too whose keys and bits differ, and with keys that find hardly any."""
    import random

    rnd = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
        common = [f"c{x}" for x in range(40)]
        rows.append((3 * k, " ".join(words + common)))
        for c in (1, 2):
            copy = list(words)
            for at in rnd.sample(range(120), 3):
                copy[at] = f"new{rnd.randint(0, 10**9)}"
            rows.append((3 * k + c, " ".join(copy + common)))
    root = similar_brute(rows)
    docs = frame(spark, rows)
    assert 70 < sum(a != b for a, b in root.items()) <= 120
    for options in ({}, {"tables": 2, "share": 6, "apart": 12}):
        links = [(r["a"], r["b"]) for r in similar_links(docs, **options).collect()]
        assert components(sorted(root), links) == root


def test_prefixes_lose_no_similar_sets(monkeypatch):
    """Sets of all sizes, with rare and frequent tokens: whatever is similar meets at a token, in places of any size."""
    from gleaner.llm import prefixes, simhash

    rnd = np.random.default_rng(3)
    for few in (32, 3):
        monkeypatch.setattr(prefixes, "FEW", few)
        base = [rnd.choice(400, rnd.integers(1, 60), replace=False) for _ in range(40)]
        sets = [np.unique(np.where(rnd.random(len(x)) < 0.08, rnd.integers(400, 5000, len(x)), x)).astype(np.uint64) for x in base for _ in range(4)]
        size = np.array([len(x) for x in sets])
        token, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, at, times = np.unique(token, return_inverse=True, return_counts=True)
        some = times[at] > 1
        which, place = prefixes.prefix_places(size, own[some], token[some], times[at][some], 0.8)
        key, who = token[some][which].view(np.int64), own[some][which]
        a, b = prefixes.meeting(key, np.ones(len(key), bool), size[who], place, who, 0.8)
        found = components(range(len(sets)), zip(who[a].tolist(), who[b].tolist()))
        near = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
        assert len(near) > 40 and all(found[i] == found[j] for i, j in near)
        assert len(set(found.values())) > 20


def test_prefixes_of_texts_in_blocks_and_slices(spark, monkeypatch):
    """Tokens counted in blocks and slices of any size give the prefixes of the whole table."""
    from gleaner.llm import prefixes, simhash

    rows = [(k % 50, " ".join(f"w{x % 23}" for x in range(k, k + k % 37))) for k in range(120)] + [(200, None), (201, "alone of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = lambda text: simhash.shingle_set(text, 3)
    sets = [tokens(t) for _, t in rows]
    df = {}
    for x in np.concatenate(sets).tolist():
        df[x] = df.get(x, 0) + 1
    want = []
    for (d, _), own in zip(rows, sets):
        ranked = sorted(own.tolist(), key=lambda x: (df[x], x))
        shared = sum(df[x] > 1 for x in ranked)
        least = -(-8 * len(own) // 10)
        want += [(x, d, len(own), at) for at, x in enumerate(ranked[: len(own) - least + 1]) if df[x] > 1 and shared >= least]
    for block, piece in ((1 << 20, 1 << 21), (40, 30)):
        monkeypatch.setattr(prefixes, "BLOCK", block)
        monkeypatch.setattr(prefixes, "SLICE", piece)
        assert sorted(map(tuple, prefixes.prefixes(docs, tokens, 0.8).collect())) == sorted(want) and len(want) > 100
