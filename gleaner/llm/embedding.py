"""Embedding near-duplicates through a pivot-permutation index.

Vectors are described by their ``near`` nearest of some reference vectors (pivots), which are a
random sample of the vectors, so that dense regions have more of them. Two vectors are candidates
if they share ``shared`` pivots. Pivots are ordered by how many vectors list them, the rarest
first; two sets that share ``shared`` pivots have one in common among their first
``near - shared + 1``, so only these go into the inverted lists. Lists hold ids and pivots only.
Shared pivots are counted from postings within each list, and a pair counts in the list of the
first pivot that it shares, once. Vectors are then fetched for those rows that have a candidate,
and verified by cosine in double precision. Long lists are cut into blocks and blocks are compared in
pairs. Lists return the sum of links for each vector and a spanning forest, never the pairs.

The number of pivots grows with the square root of the largest label, so lists do too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tasks import hook
from gleaner.operators.components import connected_components
from gleaner.session import materialise

COSINE, NEAR = 0.93, 10
#: Bounds of the number of pivots, and vectors in a block of a list.
FEWEST, MOST, BLOCK = 128, 65_536, 8192
#: Pairs whose shared pivots are counted at once, and rows of short lists that one task group takes together.
PAIRS, TOGETHER = 1 << 21, 8192


def pivots_for(rows: int) -> int:
    """Pivots for a largest label of so many distinct vectors: four times the square root, as a power of two."""
    return min(MOST, max(FEWEST, 1 << math.ceil(math.log2(4 * math.sqrt(max(1, rows))))))


def shared_for(pivots: int) -> int:
    """Pivots that candidates share: of pairs of cosine 0.93 in 64 dimensions, with ten nearest,
    99 % or more do; the more pivots there are, the fewer unrelated pairs do."""
    return 4 if pivots <= 128 else 3 if pivots <= 2048 else 2


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` nearest pivots of each vector, nearest first."""
    out = np.empty((len(unit), min(near, len(pivots))), np.int32)
    step = max(1, (1 << 22) // max(1, len(pivots)))
    for at in range(0, len(unit), step):
        far = -(unit[at : at + step] @ pivots.T)
        if out.shape[1] < far.shape[1]:
            some = np.argpartition(far, out.shape[1], axis=1)[:, : out.shape[1]]
        else:
            some = np.broadcast_to(np.arange(far.shape[1]), far.shape).copy()
        out[at : at + step] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def candidates(left: np.ndarray, right: np.ndarray, shared: int, rank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of two blocks that share enough pivots, the first of them being ``rank``.

    Blocks hold the ranks of each vector's pivots. The right block's postings are looked up for
    every pivot of the left one.
    """
    near, n = left.shape[1], len(right)
    order = np.argsort(right, axis=None, kind="stable")
    values, member = right.ravel()[order], order // near
    step = max(1, PAIRS // max(1, n))
    for at in range(0, len(left), step):
        part = left[at : at + step].ravel()
        lo = np.searchsorted(values, part, "left")
        sizes = np.searchsorted(values, part, "right") - lo
        before = np.cumsum(sizes) - sizes
        found = member[np.arange(sizes.sum()) + np.repeat(lo - before, sizes)]
        pair = np.repeat(np.arange(len(part)) // near, sizes) * n + found
        count = np.bincount(pair, minlength=len(part) // near * n)
        count[pair[np.repeat(part < rank, sizes)]] = 0
        i, j = np.divmod(np.flatnonzero(count >= shared), n)
        yield i + at, j


def _unit(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of an array."""
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def _choose(vectors: DataFrame, pivots: int) -> dict[int, tuple[int, np.ndarray]]:
    """Pivots by length of the vectors, each with the number of its first one: ``pivots`` vectors at
    most, the first by a hash of their ids."""
    found = vectors.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("size", "embedding").toArrow()
    out, first, sizes = {}, 0, found.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        own = _unit(found.filter(pa.array(sizes == size)).column("embedding"), size)
        out[size] = (first, own)
        first += len(own)
    return out


GROUP = ["label", "size", "bucket", "low", "high"]
KEYS = "label int, size int, bucket int, low int, high int"


def _links(vectors: DataFrame, cosine: float, pivots: int | None, near: int, shared: int | None) -> DataFrame:
    """``src, dst, links``: a row with null ``dst`` has a vector's links, the others span them.

    ``vectors``: ``label, rep, copies, embedding``.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("label", "rep", "copies", "embedding", F.size("embedding").alias("size"))
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pivots = pivots or pivots_for(largest)
    shared = shared or shared_for(pivots)
    chosen = spark.sparkContext.broadcast(_choose(vectors, pivots))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                first, refs = chosen.value.get(size, (pivots, None))
                # a length that no pivot has: one list for all its vectors
                found = np.zeros((part.num_rows, 1), np.int32) if refs is None else nearest_pivots(_unit(part.column("embedding"), size), refs, near)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((found + first).tolist(), pa.list_(pa.int32()))], [*part.schema.names, "near"])

    described = materialise(vectors.mapInArrow(describe, "label int, rep long, copies long, embedding array<float>, size int, near array<int>"), "described")
    used = np.zeros(pivots + 1, np.int64)
    for r in described.select(F.explode("near").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect():
        used[r["p"]] = r["n"]
    order = np.empty(pivots + 1, np.int32)
    order[np.argsort(used, kind="stable")] = np.arange(pivots + 1)
    rank_of = spark.sparkContext.broadcast(order)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = pa.table(batch.filter(pa.array(sizes == size)))
                ranks = np.sort(rank_of.value[_lists(part.column("near"))], axis=1)
                enough = min(shared, ranks.shape[1])
                first = ranks[:, : ranks.shape[1] - enough + 1]
                row = np.repeat(np.arange(len(ranks)), first.shape[1])
                own = part.select(["label", "size", "rep"]).take(pa.array(row))
                table = own.append_column("list", pa.array(first.ravel())).append_column("ranks", pa.array(ranks[row].tolist(), pa.list_(pa.int32())))
                yield from table.combine_chunks().to_batches()

    posted = described.select("label", "size", "rep", "near").mapInArrow(post, "label int, size int, rep long, list int, ranks array<int>")
    posted = materialise(posted, "posted")
    lists = posted.groupBy("label", "size", "list").agg(F.count("*").alias("n")).where("n > 1")
    lists = materialise(lists.select("label", "size", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    buckets = max(1, min(pivots, -(-largest * (near - min(shared, near) + 1) // TOGETHER)))
    dealt = posted.join(lists, ["label", "size", "list"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "size", (F.col("list") % buckets).alias("bucket"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "list", "block", "rep", "ranks")

    def pairs(key: tuple, group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates among the rows of a group, list by list."""
        low, high = key[3].as_py(), key[4].as_py()
        ranks, block, lists = _lists(group.column("ranks")), group.column("block").to_numpy(), group.column("list").to_numpy()
        order = np.argsort(lists, kind="stable")
        cuts = np.flatnonzero(np.diff(lists[order], prepend=-1, append=-1)).tolist()
        for x, y in zip(cuts[:-1], cuts[1:]):
            own = order[x:y]
            mine, theirs = own[block[own] == low], own[block[own] == high]
            for i, j in candidates(ranks[mine], ranks[theirs], min(shared, ranks.shape[1]), int(lists[own[0]])):
                i, j = mine[i], theirs[j]
                yield (i[i < j], j[i < j]) if low == high else (i, j)

    def count(key: tuple, group: pa.Table) -> pa.Table:
        """The rows of a pair of blocks that have a candidate."""
        some = np.zeros(group.num_rows, bool)
        for i, j in pairs(key, group):
            some[i] = some[j] = True
        return group.filter(pa.array(some)).select([*GROUP, "list", "block", "rep", "ranks"])

    found = dealt.groupBy(*GROUP).applyInArrow(count, f"{KEYS}, list int, block int, rep long, ranks array<int>")
    fetched = materialise(found, "candidates").join(described.select("rep", "copies", "embedding"), "rep")

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        unit = _unit(group.column("embedding"), key[1].as_py())
        links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, j in pairs(key, group):
            for x in range(0, len(i), 1 << 16):
                a, b = i[x : x + (1 << 16)], j[x : x + (1 << 16)]
                close = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                a, b = a[close], b[close]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                hook(parent, a, b)
        some, low_ends = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(rep)))
        return pa.table(
            {
                "src": np.concatenate((rep[some], rep[low_ends])),
                "dst": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[parent[low_ends]])]),
                "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(low_ends), pa.int64())]),
            }
        )

    return fetched.groupBy(*GROUP).applyInArrow(verify, "src long, dst long, links long")


def link_vectors(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, near: int = NEAR, shared: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine, in double precision, is
    at least ``cosine``. Embeddings that are null, empty, zero or hold a null or non-finite
    component link with nothing, as do rows with a null label or id, and embeddings of different
    length. Equal vectors of a label are compared as one and count as many; of repeated rows each
    counts. Null ids form a component each, its id null. Other columns are not read. An empty
    table gives no rows. Candidates may lack links; :func:`shared_for` says how many.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0)
    key = F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.concat_ws(",", F.transform("embedding", lambda v: (v + F.lit(0.0).cast("float")).cast("string"))), 256))
    keyed = rows.select("vec_id", "label", "embedding", key.alias("key"))
    classes = keyed.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"))
    classes = materialise(classes, "vectors")
    found = _links(classes.select("label", "rep", "copies", "embedding"), cosine, pivots, near, shared)
    found = materialise(found, "links")
    links = found.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("dst is not null"))
    named = classes.select("label", "key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = keyed.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
