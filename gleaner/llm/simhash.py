"""SimHash near-duplicates: exact Hamming search through vantage-point trees.

Distinct fingerprints are dealt to the leaves of a vantage-point tree. Its upper levels are built on
the driver from a bounded sample; those below have vantage points by a hash of the node's number,
so that the tree is as deep as the input needs. A fingerprint has one home leaf; it also visits those leaves beyond a boundary
that its ball of the search radius crosses. By the triangle inequality every pair within the
radius then meets in exactly one leaf, as the home of one and as the home or a visit of the other.
Within a leaf a local tree of the same kind prunes the comparisons. Leaves return a spanning
forest of their links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.prefixes import candidates, prefixes
from gleaner.llm.tasks import column, hook, listed, mix64, pack_sorted, release, slices, unpack_sorted, utf8, without
from gleaner.operators.components import connected_components
from gleaner.session import materialise

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bound of the sample from which the driver builds the tree, and least fingerprints to a leaf.
SAMPLE, LEAF = 100_000, 4096
#: Below this many fingerprints a leaf compares all of them.
DENSE = 768
#: Bits of a sketch of a shingle set, and documents of a shard that are searched at once.
PRINT, CROWD = 128, 2048
#: Documents that one copy of a document's shingles is compared with.
PARTNERS = 256
#: Bytes of packed shingles in a part of a group; a task compares two parts.
PACK = 1 << 22


# Fingerprints


def bit_majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the 64-bit hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(part), 255), axis=0)  # 8 counters a word, none over 255
        total += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles; 0 for a text without words, the one shingle of a short one."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return bit_majority(np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
    return bit_majority(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# The distributed tree


def build_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Vantage point and boundary of each inner node of a full tree, in heap order."""
    nodes: list[tuple[int, int]] = [(0, 64)] * (2**depth - 1)
    parts = {0: sample}
    for at in range(len(nodes)):
        part = parts.pop(at)
        if not len(part):
            part = sample[:1]
        vantage = part[at % len(part)]
        far = np.bitwise_count(part ^ vantage)
        bound = int(np.median(far)) if len(part) > 1 else 32
        nodes[at] = (int(vantage), bound)
        parts[2 * at + 1], parts[2 * at + 2] = part[far <= bound], part[far > bound]
    return nodes


def vantage_of(at: int, nodes: list[tuple[int, int]]) -> tuple[np.uint64, int]:
    """Vantage point and boundary of a node: below the nodes of the sample, a hash of its number, and
    the middle of the distances to a random point, 31 and 32 in turn."""
    if at < len(nodes):
        return np.uint64(nodes[at][0]), nodes[at][1]
    return mix64(np.array([at], np.uint64))[0], 31 + at % 2


def route(fps: np.ndarray, nodes: list[tuple[int, int]], radius: int, depth: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """``(leaf, indexes, home)``: where each fingerprint lives and which leaves it visits."""
    inner = 2**depth - 1
    everyone, none = np.arange(len(fps)), np.empty(0, np.int64)
    todo = [(0, everyone, none)]
    while todo:
        at, homes, visits = todo.pop()
        if not len(homes) and not len(visits):
            continue
        if at >= inner:
            yield at - inner, homes, True
            yield at - inner, visits, False
            continue
        vantage, bound = vantage_of(at, nodes)
        h, v = np.bitwise_count(fps[homes] ^ vantage), np.bitwise_count(fps[visits] ^ vantage)
        crossing = homes[(h <= bound) & (h + radius > bound)]
        todo.append((2 * at + 1, homes[h <= bound], visits[v <= bound + radius]))
        todo.append((2 * at + 2, homes[h > bound], np.concatenate((crossing, visits[v + radius > bound]))))


# Search within a leaf


Accept = Callable[[np.ndarray, np.ndarray], np.ndarray] | None


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, parent: np.ndarray, accept: Accept = None) -> None:
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[b][None, :]) <= radius)
        i, j = part[i], b[j]
        if accept is not None:
            good = accept(i, j)
            i, j = i[good], j[good]
        hook(parent, i, j)


def _between(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, parent: np.ndarray, turn: int = 0, accept: Accept = None) -> None:
    """Links between two sets of indexes."""
    todo = [(a, b, turn)]
    while todo:
        a, b, turn = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) <= DENSE or len(b) <= DENSE or turn > 40:
            _compare(fps, a, b, radius, parent, accept)
            continue
        vantage = fps[(a if turn % 2 else b)[(turn * 7919) % min(len(a), len(b))]]
        x, y = np.bitwise_count(fps[a] ^ vantage), np.bitwise_count(fps[b] ^ vantage)
        bound = int(np.median(np.concatenate((x, y))))
        if x.max() <= bound and y.max() <= bound:
            bound = max(0, bound - 1)
        for p, q in ((x <= bound, y <= bound), (x > bound, y > bound)):
            todo.append((a[p], b[q], turn + 1))
        todo.append((a[(x <= bound) & (x + radius > bound)], b[(y > bound) & (y <= bound + radius)], turn + 1))
        todo.append((a[(x > bound) & (x <= bound + radius)], b[(y <= bound) & (y + radius > bound)], turn + 1))


def _within(fps: np.ndarray, a: np.ndarray, radius: int, parent: np.ndarray, accept: Accept = None) -> None:
    """Links within a set of indexes, by a local tree."""
    todo = [(a, 0)]
    while todo:
        a, turn = todo.pop()
        if len(a) <= DENSE or turn > 40:
            _compare(fps, a, a, radius, parent, accept)
            continue
        far = np.bitwise_count(fps[a] ^ fps[a[(turn * 7919) % len(a)]])
        bound = int(np.median(far))
        if far.max() <= bound:
            bound = max(0, bound - 1)
        near = far <= bound
        todo += [(a[near], turn + 1), (a[~near], turn + 1)]
        _between(fps, a[near & (far + radius > bound)], a[~near & (far <= bound + radius)], radius, parent, turn + 1, accept)


def leaf_links(fps: np.ndarray, home: np.ndarray, radius: int, accept: Accept = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of edges that span all links of a leaf: home to home, and home to visit."""
    parent = np.arange(len(fps))
    own, others = np.flatnonzero(home), np.flatnonzero(~home)
    _within(fps, own, radius, parent, accept)
    _between(fps, own, others, radius, parent, accept=accept)
    low = np.flatnonzero(parent != np.arange(len(fps)))
    return low, parent[low]


def leaf_forest(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that are the ends of the edges of a leaf."""
    a, b = leaf_links(fps, home, radius)
    return fps[a], fps[b]


def leaf_for(total: int) -> int:
    """Fingerprints to a leaf. Visits multiply by about 1.5 with each level, so leaves grow with the
    root of the number: dealt rows then grow with its power 1.3."""
    return max(LEAF, 1 << math.ceil(math.log2(2 * math.sqrt(max(1, total)))))


def deal_to_leaves(distinct: DataFrame, radius: int = RADIUS, leaf: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``leaf, home`` and the columns of ``distinct`` (``fp`` and others): every row in its home leaf
    and in all leaves that its ball reaches.

    Only a hash-ordered sample of at most ``sample`` fingerprints comes to the driver.
    """
    total = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, total / (leaf or leaf_for(total))))))
    upper = min(depth, int(math.log2(sample / 16)))
    share = min(1.0, sample / 2 / max(1, total)) * 2.0**32
    rows = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(2**32)) < F.lit(int(share))).select("fp").limit(sample).collect() if depth else []
    nodes = build_tree(np.array(sorted(r["fp"] for r in rows) or [0], np.int64).view(np.uint64), upper)
    names = distinct.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            fps = part.column(names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64)
            for at, who, home in route(fps, nodes, radius, depth):
                if len(who):
                    own = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), at, np.int64)), pa.array(np.full(len(who), home)), *own.columns], ["leaf", "home", *names])

    schema = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("home", T.BooleanType()), *distinct.schema])
    return distinct.mapInArrow(deal, schema)


def hamming_edges(distinct: DataFrame, radius: int = RADIUS, leaf: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """``src, dst``: edges that connect just those of the distinct ``fp`` that links connect."""

    def search(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        src, dst = leaf_forest(fps, group.column("home").to_numpy(zero_copy_only=False).astype(bool), radius)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return deal_to_leaves(distinct.select("fp"), radius, leaf, sample).groupBy("leaf").applyInArrow(search, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest doc_id that a chain of links reaches. Equal fingerprints are
    linked (all texts without words share fingerprint 0); repeated rows appear as often as given;
    a null doc_id takes part in links but is never the smallest, unless the component has no
    other, when the id is null. Other columns are not read. An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(hamming_edges(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialise(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Documents of similar five-word shingles


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; of the whole sequence if it is shorter."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        out = mix64(out * np.uint64(31) + h[k : k + n])
    return np.unique(out)


def shingle_print(hashes: np.ndarray, tables: int, share: int) -> np.ndarray:
    """A sketch of a shingle set: ``tables`` keys, then two words of bits.

    Each of ``PRINT`` permutations has a least hash, two sets the same one with the chance of their
    Jaccard similarity. A bit is the parity of one of them, so bits of two sets differ with half the
    chance that they are unlike, wherever in the texts the differences are; a key stands for
    ``share`` of those least hashes that are not in the bits.
    """
    if not len(hashes):
        return np.zeros(tables + 2, np.uint64)
    least = np.full(PRINT + tables * share, 2**64 - 1, np.uint64)
    factors = _factors(len(least))[:, None]
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (factors * hashes[None, at : at + 2048]).min(axis=1), out=least)
    bits = np.packbits((mix64(least[:PRINT]) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
    keys = np.arange(1, tables + 1, dtype=np.uint64)
    for k in range(share):
        keys = mix64(keys + least[PRINT + k :: share])
    return np.concatenate((keys, bits))


@cache
def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 40-bit hashes of the distinct word shingles.

    Two sets of 20,000 shingles have 0.0004 hashes in common by chance.
    """
    return np.unique(shingle_hashes(text, shingle) >> np.uint64(24))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def best_forest(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the forest that spans ``(i, j)`` with the least distances; the nearest of each node is among them."""
    order = np.lexsort((j, i, far))
    i, j = i[order], j[order]
    at, parent, chosen = np.arange(len(i)), np.arange(n), []
    while True:
        u, v = parent[i[at]], parent[j[at]]
        apart = u != v
        if not apart.any():
            break
        at, u, v = at[apart], u[apart], v[apart]
        first = np.full(n, len(i))
        np.minimum.at(first, u, at)
        np.minimum.at(first, v, at)
        own = np.unique(first[first < len(i)])
        chosen.append(own)
        hook(parent, i[own], j[own])
    chosen = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
    return i[chosen], j[chosen]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def group_candidates(ids: np.ndarray, p: np.ndarray, c: np.ndarray, radius: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids to compare within a shard: the best forest of what the tree finds within ``radius`` by the
    first bits, and that differs in at most ``apart`` of all."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        far = _apart(p[i], p[j]) + _apart(c[i], c[j])
        good = (far <= apart) & (i != j)
        found.append((i[good], j[good], far[good]))
        return good

    leaf_links(p, np.ones(len(p), bool), radius, accept)
    i, j = best_forest(len(p), *map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 2
    return ids[i], ids[j]


def _unlike(p: np.ndarray, c: np.ndarray, root: np.ndarray, apart: int) -> Accept:
    """Whether pairs are candidates of different roots."""

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = root[i] != root[j]
        good[good] = _apart(p[i[good]], p[j[good]]) + _apart(c[i[good]], c[j[good]]) <= apart
        return good

    return accept


def other_candidates(ids: np.ndarray, p: np.ndarray, c: np.ndarray, root: np.ndarray, radius: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that :func:`group_candidates` chooses from, but those of one ``root``."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    unlike = _unlike(p, c, root, apart)

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = unlike(i, j)
        found.append((i[good], j[good]))
        return good

    leaf_links(p, np.ones(len(p), bool), radius, accept)
    i, j = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return ids[i], ids[j]


def other_groups(ids: np.ndarray, p: np.ndarray, c: np.ndarray, root: np.ndarray, radius: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """``(group, id)`` of the groups that the pairs of :func:`other_candidates` connect: a row for each id, not for each pair.

    A group's number follows from its ids, so that a group that several shards find is one.
    """
    low, first = leaf_links(p, np.ones(len(p), bool), radius, _unlike(p, c, root, apart))
    own = np.unique(first)
    who, of = np.concatenate((low, own)), np.concatenate((first, own))
    number = np.zeros(len(p), np.uint64)
    np.add.at(number, of, mix64(ids[who].astype(np.int64).view(np.uint64) + np.uint64(1)))
    return number[of].view(np.int64), ids[who]


def similar_pairs(sets: list[np.ndarray], similarity: float, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of sorted sets with a Jaccard similarity of ``similarity`` or more that span all such pairs.

    Common hashes of a set and all before it are counted from postings, so no two sets are compared by themselves.
    Sets of one ``root``, if it is given, are joined already; those of the most frequent one, which then must come first, aren't compared.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    parent, found, joined = np.arange(n), [], 1
    if root is not None and n:
        _, first, which = np.unique(root, return_index=True, return_inverse=True)
        parent, joined = first[which], max(1, int((root == root[0]).sum()))
    _, token, df = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    postings = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    first, ends = np.cumsum(df) - df, np.cumsum(sizes)
    for k in range(joined, n):
        own = token[ends[k] - sizes[k] : ends[k]]
        many = df[own]
        at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(postings[at], minlength=n)[:k]
        union = sizes[k] + sizes[:k] - both
        j = np.flatnonzero(np.where(union > 0, both / np.maximum(union, 1), 1.0) >= similarity)
        j = j[np.unique(parent[j], return_index=True)[1]]
        j = j[parent[j] != parent[k]]
        found.append((j, np.full(len(j), k)))
        hook(parent, *found[-1])
    i, j = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return i, j


def _unjoined(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shard, doc_id, p, c, root`` of keys that documents of several roots have.

    A crowd is dealt to blocks, and every two of its blocks meet in a shard: no two of a crowd are kept apart.
    """
    rooted = shared.select("key", "n", "doc_id", "p", "c").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "doc_id")), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("n") / CROWD).cast("int")
    rows = rooted.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "doc_id", "p", "c", "root")


def _shards(prints: DataFrame, tables: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two tables ``shard, doc_id, p, c``, of documents by each of their keys that another has too, of crowds ``doc_id, p, c, first``, and all keys that are shared.

    A key that over ``CROWD`` documents have deals them again, by that key and their next one, and what is a
    crowd even so to as many parts as it needs. In each crowd everyone is in a shard with the one of
    the smallest id too, so that no part of a crowd is by itself.
    """
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(f"k{k}").alias("key"), F.col(f"k{(k + 1) % tables}").alias("finer")) for k in range(tables)]))
    each = prints.select("doc_id", "p", "c", key.alias("k")).select("doc_id", "p", "c", F.xxhash64("k.t", "k.key").alias("key"), F.xxhash64("k.t", "k.key", "k.finer").alias("finer"))
    each = materialise(each, "keys")

    def crowds(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "p", "c")).alias("first")).where("n > 1")
        return materialise(found, "crowds")  # joined as the planner sees fit: a key of many rows is split

    found = crowds(each, "key")
    first = each.join(listed(found.select("key")), "key", "left_semi").join(found, "key")  # most keys are of one row, which isn't shuffled
    first = materialise(first, "shared")
    small = first.where(F.col("n") <= CROWD).select(F.col("key").alias("shard"), "doc_id", "p", "c")
    large = first.where(F.col("n") > CROWD)
    again = materialise(large.drop("n").withColumnRenamed("first", "outer").join(crowds(large, "finer"), "finer"), "again")
    parts = F.ceil(F.col("n") / CROWD)
    shard = F.xxhash64("finer", F.pmod(F.xxhash64("doc_id"), parts))
    return small, again.select(shard.alias("shard"), "doc_id", "p", "c"), large.select("doc_id", "p", "c", "first").unionByName(again.select("doc_id", "p", "c", "first")), first


def similar_links(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tables: int = 8, share: int = 4, radius: int = 18, apart: int = 28, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Fingerprints are bits of least shingle hashes, so their distance follows the similarity, whatever was edited.
    At 0.8 a tenth of their bits differ, which no boundary of a tree by distance tells from chance at a useful
    rate; so shards are dealt by keys of ``share`` least hashes, which similar documents have in common
    with a chance of ``similarity ** share`` for each of ``tables``, and the tree of op6 searches
    within each shard. A shard gives the forest of its nearest pairs; each of these is verified
    by the whole shingle sets. A second round verifies every candidate pair that these links haven't joined, whichever was nearer and
    whatever part of a crowd it is in: it sends the sets of a group that such pairs connect to one place, a row for each document, and
    returns pairs that span the group's links. What shares no key (0.015 at 0.8) or differs in bits by chance is left to a third round,
    which is exact: sets that share a token of their prefixes (:mod:`gleaner.llm.prefixes`) and aren't joined yet are compared
    likewise. So links join all that belong together, and nothing else. Rows without an id are left out; documents without words are similar. Of an id that repeats any text counts.
    """
    rows = docs.where(column(id_col).isNotNull()).select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            found = np.array([shingle_print(shingle_hashes(t, shingle), tables, share) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, tables + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(x)) for x in found.T]], ["doc_id", *names])

    def search(group: pa.Table) -> pa.Table:
        ids, p, c = (group.column(x).to_numpy() for x in ("doc_id", "p", "c"))
        a, b = group_candidates(ids, p.view(np.uint64), c.view(np.uint64), radius, apart)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    names = [*[f"k{k}" for k in range(tables)], "p", "c"]
    prints = materialise(rows.mapInArrow(describe, "doc_id long, " + ", ".join(f"{c} long" for c in names)), "prints")
    small, split, crowded, shared = _shards(prints, tables)
    found = small.unionByName(split).groupBy("shard").applyInArrow(search, "a long, b long")
    bits = F.bit_count(F.col("p").bitwiseXOR(F.col("first.p"))) + F.bit_count(F.col("c").bitwiseXOR(F.col("first.c")))
    found = found.unionByName(crowded.where(bits <= apart).select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack_sorted(shingle_set(t, shingle)) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "shingles"])

    def verify(group: pa.Table) -> pa.Table:
        hashes = [unpack_sorted(x, np.uint64) for x in group.column("shingles").to_pylist()]
        ids = group.column("b").to_pylist()
        own = [h for h, b in zip(hashes, ids) if b is None]
        good = sorted({b for h, b in zip(hashes, ids) if b is not None and any(jaccard(x, h) >= similarity for x in own)})
        return pa.table({"a": pa.array([group.column("a")[0].as_py()] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    def verified(found: DataFrame) -> DataFrame:
        ends = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        ends = materialise(ends, "ends")
        # a document with many candidates is compared with them in parts, each with its own copy of it
        parts = ends.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        ends = materialise(ends.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part"), "parted")
        wanted = materialise(ends.select(F.col("a").alias("doc_id")).unionByName(ends.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
        shingles = rows.join(listed(wanted), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary")
        shingles = materialise(shingles, "shingles")
        left = ends.select("a", "part").distinct().join(shingles.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
        right = ends.join(shingles.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "shingles")
        return left.unionByName(right).groupBy("a", "part").applyInArrow(verify, "a long, b long")

    def others(group: pa.Table) -> pa.Table:
        ids, p, c, root = (group.column(x).to_numpy() for x in ("doc_id", "p", "c", "root"))
        number, who = other_groups(ids, p.view(np.uint64), c.view(np.uint64), root, radius, apart)
        return pa.table({"group": pa.array(number, pa.int64()), "doc_id": pa.array(who, pa.int64())})

    def compare(group: pa.Table) -> pa.Table:
        ids, root = (group.column(x).to_numpy() for x in ("doc_id", "root"))
        _, which, many = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((which, -many[which]))  # the largest class comes first
        shingles, ids = group.column("shingles"), ids[order]
        a, b = similar_pairs([unpack_sorted(shingles[k].as_py(), np.uint64) for k in order.tolist()], similarity, root[order])
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    def grouped(left: DataFrame, roots: DataFrame) -> DataFrame:
        groups = materialise(left.distinct(), "groups")
        wanted = materialise(groups.select("doc_id").distinct(), "wanted")
        shingles = materialise(rows.join(listed(wanted), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary"), "shingles")
        sizes = shingles.select("doc_id", F.octet_length("shingles").cast("long").alias("size"))
        parts = groups.join(sizes, "doc_id").groupBy("group").agg(F.ceil(F.sum("size") / PACK).cast("int").alias("parts"))
        # a group of large sets is dealt to parts, and every two of its parts meet
        dealt = groups.join(parts, "group").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("pack"), "doc_id")
        dealt = dealt.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        return materialise(dealt, "packs").join(shingles, "doc_id").groupBy("pack").applyInArrow(compare, "a long, b long")

    sure = materialise(verified(found), "links")
    roots = connected_components(sure, "a", "b")
    left = _unjoined(shared, roots).groupBy("shard").applyInArrow(others, "group long, doc_id long")
    sure = materialise(sure.unionByName(grouped(left, roots)), "links")
    # what shares no key, or differs in bits by chance, is found by what similar sets must share
    roots = connected_components(sure, "a", "b")
    rest = candidates(prefixes(rows, lambda text: shingle_set(text, shingle), similarity), roots, similarity)
    rest = connected_components(rest, "a", "b").select(F.col("root").alias("group"), F.col("node").alias("doc_id"))
    return sure.unionByName(grouped(rest, roots))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` but those whose id is joined by :func:`similar_links` to a smaller one.

    All columns stay. Rows that share an id stand together; rows without an id stay.
    """
    roots = connected_components(similar_links(docs, id_col=id_col, text_col=text_col, **options), "a", "b")
    gone = roots.where("node <> root").select(F.col("node").alias("doc_id"))
    return without(docs, materialise(gone, "gone"), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows that share an id stand together: they stay if one of them does. Rows without an id stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).where("stays = 0")
    return without(docs, materialise(gone.select("doc_id"), "gone"), id_col)
