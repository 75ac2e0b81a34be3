"""Small helpers for code that runs on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*[column(c).alias(c) for c in docs.columns])


#: Rows of a list of ids that is broadcast; a longer one is joined as the planner sees fit.
LISTED = 2_000_000


def listed(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if they are few enough by count."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``gone`` (``doc_id``, a null among them stands for null ids)."""
    gone = listed(gone.select(F.col("doc_id").alias("gone_id")))
    packed = docs.select(whole_row(docs).alias("row"), column(id_col).alias("d_id"))
    return packed.join(gone, F.col("d_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few hundred rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task: one thing, the last that was asked for."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what this process keeps. Spark gives the tasks of a stage the workers of those before it,
    whose tables would stand beside its own."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, each compressed by itself; small values take few bytes.

    Head: the number of values, then the size of each plane; 0 stands for zeros only, and a plane
    that doesn't shrink is stored as it is.
    """
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.empty((values.itemsize, 0), np.uint8)
    parts = []
    for plane in planes:
        small = zstandard.compress(plane.tobytes(), 1) if plane.any() else b""
        parts.append(small if len(small) < len(plane) else plane.tobytes())
    return np.array([len(values), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def unpack(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    n, *sizes = np.frombuffer(data[: 4 * width + 4], np.uint32).tolist()
    planes, at = np.zeros((width, n), np.uint8), 4 * width + 4
    for plane, size in zip(planes, sizes):
        if size:
            part = data[at : at + size]
            plane[:] = np.frombuffer(part if size == n else zstandard.decompress(part), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as packed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (SplitMix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hook(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of ``u[i]`` and ``v[i]`` in the union-find array ``parent``, in place."""
    while len(u):
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
