"""Numbered versions of a small record, of which each is written once: compare and swap on a folder.

A version is a file named by its number, made only if it is absent, through Spark's own file
systems. Of several writers that build on the same version one gets the next number; the
others see that they lost, and build on what it published. A file that a writer left unfinished is
no version, and keeps its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from gleaner.errors import Code, EngineError

#: How often a writer builds anew on what others published before it gives up.
TRIES = 20


def _store(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether something is at ``folder``; that it can't be read is another matter, and an error."""
    _, path, fs = _store(spark, folder)
    return fs.exists(path)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    _, path, fs = _store(spark, folder)
    if not fs.exists(path):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(path))
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The number and record of the last finished version; None where there is none."""
    jvm, _, fs = _store(spark, folder)
    for number in reversed(_numbers(spark, folder)):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number:012d}.json"))
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return number, json.loads(text)
        except ValueError:
            continue
    return None


def put(spark: SparkSession, folder: str, base: int, record: dict) -> int | None:
    """The number under which ``record`` was published, or None if ``base`` (0: none) isn't the latest any more."""
    found = latest(spark, folder)
    if (found[0] if found else 0) != base:
        return None
    jvm, _, fs = _store(spark, folder)
    number = max([base, *_numbers(spark, folder)]) + 1
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number:012d}.json"), False)
    except Py4JJavaError as failure:
        if "AlreadyExists" in str(failure.java_exception):
            return None
        raise EngineError(Code.INDEX_WRITE_FAILED, f"version {number} can't be written") from failure
    try:
        out.write(json.dumps(record).encode())
    finally:
        out.close()
    return number


def swap(spark: SparkSession, folder: str, build: Callable[[dict | None], dict]) -> dict:
    """Publish what ``build`` makes of the latest record, which it gets anew each time that another writer was first."""
    for _ in range(TRIES):
        found = latest(spark, folder)
        record = build(found[1] if found else None)
        if put(spark, folder, found[0] if found else 0, record) is not None:
            return record
    raise EngineError(Code.INDEX_BUSY, "others published again and again")
