"""Similar sets that no sketch has brought together: an exact search by prefixes.

Two sets whose Jaccard similarity is ``t`` or more have ``t / (1 + t)`` of the sum of their sizes in common.
Where all tokens are laid out in one order, the first one that they share leaves room for so many in
both of them, so it is among the first ``(1 - t)`` of each: the prefix. The order is that of
rarity, ties by token. A token of one set only can't be shared, and comes first, so a set that
shares less than ``t`` of its tokens with any others has no candidate and is done; a frequent passage comes last.

1. Blocks of sets send their tokens, dealt to slices by value, each once with the places of its sets in the block.
2. A slice counts its tokens, and sends back to each block those that occur repeatedly, with their numbers.
3. A block then has the order of each of its sets, and gives the shared tokens of their prefixes.
4. Sets that share such a token, and whose sizes and places allow the similarity, are candidates. Of
   those that are joined already only pairs between different classes are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tasks import hook, pack, pack_sorted, release, slices, unpack, unpack_sorted
from gleaner.session import materialise

#: Bits of a token. Tokens of a block and of a slice, and bytes of text for a token by which slices are numbered.
BITS, BLOCK, SLICE, TOKEN = 40, 1 << 20, 1 << 21, 5
#: Rows of prefixes in a task, and sets that share a token and meet in one place.
SHARD, CROWD = 200_000, 2048
#: Sets of a token up to which pairs are formed for all tokens at once.
FEW = 32
_SLACK = 1e-6


def least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    """Tokens that a set of ``n`` shares at least with any similar one."""
    return np.ceil(similarity * n - _SLACK).astype(np.int64)


def allowed(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` tokens can be similar whose first common token is at ``at`` and ``bt``."""
    return similarity / (1 + similarity) * (n + m) - _SLACK <= np.minimum(n - at, m - bt)


def prefix_places(size: np.ndarray, own: np.ndarray, token: np.ndarray, df: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``(which, place)``: of shared tokens (``own``, the number of their set, and ``df``) those in a prefix, and their places in it.

    ``size`` is that of each set, with the tokens that no other has.
    """
    shared = np.bincount(own, minlength=len(size))
    least = least_shared(size, similarity)
    some = np.flatnonzero((shared >= least)[own])
    order = some[np.lexsort((token[some], df[some], own[some]))]
    nth = np.arange(len(order)) - np.searchsorted(own[order], own[order])
    place = (size - shared)[own[order]] + nth
    inside = place <= (size - least)[own[order]]
    return order[inside], place[inside]


def prefixes(rows: DataFrame, tokens: Callable[[str | None], np.ndarray], similarity: float) -> DataFrame:
    """``key, doc_id, n, place``: the shared tokens in the prefix of each row of ``rows`` (doc_id, text).

    ``tokens`` gives the sorted set of a text, of numbers below ``2 ** BITS``; ``n`` is its size.
    """
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(total / TOKEN / SLICE))
    bounds = np.array([(k << BITS) // parts for k in range(parts + 1)], np.uint64)

    def frames(ids: list[np.ndarray], sets: list[np.ndarray], block: int) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.uint32)
        token, own = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        cuts = np.searchsorted(token, bounds).tolist()
        found = []
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                each, times = np.unique(token[x:y], return_counts=True)
                found.append((k, pack_sorted(each), pack(times.astype(np.uint32)), pack(own[x:y])))
        # the ids and sizes go with them, to be passed on
        found.append((parts + block % parts, pack(np.concatenate(ids).view(np.uint64)), None, pack(sizes)))
        k, a, n, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([block] * len(k), pa.int64()), *[pa.array(c, pa.binary()) for c in (a, n, b)]], ["slice", "block", "a", "n", "b"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block, held = TaskContext.get().partitionId() << 32, 0
        ids, sets = [], []
        for part in slices(batches, 256):
            ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            sets += [tokens(t) for t in part.column(1).to_pylist()]
            held += sum(map(len, sets[-part.num_rows :]))
            if held >= BLOCK:
                yield frames(ids, sets, block)
                ids, sets, held, block = [], [], 0, block + 1
        if ids:
            yield frames(ids, sets, block)

    def count(group: pa.Table) -> pa.Table:
        blocks, a, n, b = (group.column(c).to_pylist() for c in ("block", "a", "n", "b"))
        out = [(number, x, None, y, None) for number, x, y in zip(blocks, a, b)]
        if group.column("slice")[0].as_py() < parts:
            # a token is here once for each block, however many sets have it
            each, times = [unpack_sorted(x, np.uint64) for x in a], [unpack(x, np.uint32) for x in n]
            _, which = np.unique(np.concatenate(each), return_inverse=True)
            df = np.bincount(which, np.concatenate(times)).astype(np.uint32)[which]
            ends, out = np.cumsum([len(x) for x in each]), []
            for number, own, part, many, end in zip(blocks, b, each, times, ends.tolist()):
                all_sets = df[end - len(part) : end]
                some = all_sets > 1
                if some.any():
                    out.append((number, pack_sorted(part[some]), pack(many[some]), pack(unpack(own, np.uint32)[np.repeat(some, many)]), pack(all_sets[some])))
        k, *rest = zip(*out) if out else ((),) * 5
        return pa.table({"block": pa.array(k, pa.int64())} | {c: pa.array(x, pa.binary()) for c, x in zip(("a", "n", "b", "df"), rest)})

    def order(group: pa.Table) -> pa.Table:
        a, n, b, df = (group.column(c).to_pylist() for c in ("a", "n", "b", "df"))
        head = df.index(None)
        ids, size = unpack(a[head], np.uint64).view(np.int64), unpack(b[head], np.uint32).astype(np.int64)
        told = [k for k in range(len(df)) if k != head]
        times = np.concatenate([unpack(n[k], np.uint32) for k in told] or [np.empty(0, np.uint32)])
        token = np.repeat(np.concatenate([unpack_sorted(a[k], np.uint64) for k in told] or [np.empty(0, np.uint64)]), times)
        own = np.concatenate([unpack(b[k], np.uint32) for k in told] or [np.empty(0, np.uint32)]).astype(np.int64)
        many = np.repeat(np.concatenate([unpack(df[k], np.uint32) for k in told] or [np.empty(0, np.uint32)]), times)
        which, place = prefix_places(size, own, token, many, similarity)
        own = own[which]
        return pa.table({"key": pa.array(token[which].view(np.int64)), "doc_id": pa.array(ids[own]), "n": pa.array(size[own]), "place": pa.array(place.astype(np.int64))})

    sent = rows.select("doc_id", "text").mapInArrow(send, "slice long, block long, a binary, n binary, b binary")
    counted = sent.groupBy("slice").applyInArrow(count, "block long, a binary, n binary, b binary, df binary")
    return counted.groupBy("block").applyInArrow(order, "key long, doc_id long, n long, place long")


def meeting(spot: np.ndarray, home: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places in the arrays) that connect what candidate pairs of a ``spot`` connect: two of different roots, one at least at home."""
    order = np.lexsort((~home, spot))
    first, end = (np.searchsorted(spot[order], spot[order], side=x) for x in ("left", "right"))

    def join(parent: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        a, b = rows[i], rows[j]
        good = home[a] & (root[a] != root[b])
        good[good] = allowed(n[a[good]], place[a[good]], n[b[good]], place[b[good]], similarity)
        hook(parent, i[good], j[good])

    def edges(parent: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.flatnonzero(parent != np.arange(len(parent)))
        return rows[low], rows[parent[low]]

    parent, at = np.arange(len(order)), np.flatnonzero(end - first <= FEW)
    for far in range(1, FEW):
        at = at[at + far < end[at]]
        if len(at):
            join(parent, order, at, at + far)
    found = [edges(parent, order)]
    for k in np.unique(first[end - first > FEW]).tolist():
        rows = order[k : end[k]]
        parent, own = np.arange(len(rows)), np.flatnonzero(home[rows])
        step = max(1, (1 << 20) // len(rows))
        for x in range(0, len(own), step):
            i, j = np.nonzero(root[rows[own[x : x + step]]][:, None] != root[rows][None, :])
            join(parent, rows, own[x + i], j)
        found.append(edges(parent, rows))
    a, b = map(np.concatenate, zip(*found))
    return a, b


def candidates(prefixed: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: ids that connect all candidate pairs of ``prefixed`` (:func:`prefixes`) whose ids ``roots`` (node, root) doesn't join.

    What shares a token is dealt to places of ``CROWD``; the largest class of a token is at one of them each, and all
    others visit every one, so no two of different classes are kept apart.
    """
    rooted = prefixed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = materialise(rooted, "prefixes")
    classes = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = classes.groupBy("key").agg(F.max(F.struct("m", "root"))["root"].alias("most"), F.sum("m").alias("sets"), F.count("*").alias("classes")).where("classes > 1")
    rows = rooted.join(mixed.drop("classes"), "key")
    parts = F.ceil(F.col("sets") / CROWD).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("root") == F.col("most"), F.array("own")).otherwise(F.sequence(F.lit(0), parts - 1))))
    rows = rows.select(F.xxhash64("key", "at").alias("spot"), (F.col("at") == F.col("own")).alias("home"), "doc_id", "n", "place", "root")
    rows = materialise(rows, "meeting")
    tasks = max(1, math.ceil(rows.count() / SHARD))

    def meet(group: pa.Table) -> pa.Table:
        spot, home, ids, n, place, root = (group.column(c).to_numpy() for c in ("spot", "home", "doc_id", "n", "place", "root"))
        i, j = meeting(spot, home.astype(bool), n, place, root, similarity)
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64())})

    return rows.withColumn("shard", F.pmod("spot", F.lit(tasks))).groupBy("shard").applyInArrow(meet, "a long, b long")
