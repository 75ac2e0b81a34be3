"""Run units: results that are made once for given inputs, and kept.

``<root>/<identity>/inputs`` has the inputs, the identity being their digest; ``<unit>/log`` has a row
for each claim, release and result. A unit that has a result is read; else it is claimed, computed
and published by one row, so that a runner that dies leaves nothing that counts, and a resumed
run only makes what is missing.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.errors import Code, EngineError
from gleaner.operators.metrics import score_evidence
from gleaner.plans.versions import exists

LOG = "kind string, token string, at long, folder string"


def identity_of(inputs: object) -> str:
    """SHA-256 of the inputs as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def _rows(spark: SparkSession, path: str) -> list:
    return spark.read.schema(LOG).parquet(path).collect() if exists(spark, path) else []


def run_unit(spark: SparkSession, root: str, inputs: object, unit: str, compute: Callable[[str], DataFrame], claims_last: float = 3600.0) -> DataFrame:
    """The result of ``unit`` for ``inputs``: as it is kept, or of ``compute(identity)``, which is then kept.

    A unit that another runner has claimed within ``claims_last`` seconds is INDEX_BUSY; of two runners
    that claim at once both may be, never none. Names of units are letters, digits, ``_`` and ``-``.
    """
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", unit):
        raise EngineError(Code.ARGUMENT_INVALID, f"not a name for a unit: {unit!r}")
    identity = identity_of(inputs)
    at = f"{root}/{identity}"
    told = json.dumps(inputs, sort_keys=True, ensure_ascii=False)
    kept = {r["inputs"] for r in spark.read.schema("inputs string").parquet(f"{at}/inputs").collect()} if exists(spark, f"{at}/inputs") else set()
    if kept - {told}:
        raise EngineError(Code.INDEX_INVALID, f"other inputs are kept as {identity}")
    if not kept:
        spark.createDataFrame([(told,)], "inputs string").coalesce(1).write.mode("append").parquet(f"{at}/inputs")
    log, token = f"{at}/{unit}/log", uuid.uuid4().hex

    def note(kind: str, folder: str | None = None) -> None:
        spark.createDataFrame([(kind, token, time.time_ns(), folder)], LOG).coalesce(1).write.mode("append").parquet(log)

    def result() -> DataFrame | None:
        made = sorted((r for r in rows if r["kind"] == "result"), key=lambda r: (r["at"], r["token"]))
        return spark.read.parquet(f"{at}/{unit}/{made[0]['folder']}") if made else None

    rows = _rows(spark, log)
    if (found := result()) is not None:
        return found
    note("claim")
    rows = _rows(spark, log)
    if (found := result()) is not None:
        return found
    released = {r["token"] for r in rows if r["kind"] == "release"}
    since = time.time_ns() - int(claims_last * 1e9)
    if any(r["kind"] == "claim" and r["token"] not in released | {token} and r["at"] >= since for r in rows):
        note("release")
        raise EngineError(Code.INDEX_BUSY, f"{unit} is claimed by another runner")
    try:
        folder = f"result-{token}"
        compute(identity).write.parquet(f"{at}/{unit}/{folder}")
        note("result", folder)
    finally:
        note("release")
    return spark.read.parquet(f"{at}/{unit}/{folder}")


# Saved runs


def save_run(spark: SparkSession, root: str, protocol: dict, hits: DataFrame) -> str:
    """Keep the ``hits`` (query_id, rank, evidence_id) of a run; returns its identity, the digest of its protocol.

    ``protocol`` says all that the hits depend on. A run that is kept already stays as it is.
    """
    run_unit(spark, root, protocol, "hits", lambda _: hits.select("query_id", "rank", "evidence_id"))
    return identity_of(protocol)


def read_runs(spark: SparkSession, root: str, runs: list[str], must_agree: tuple[str, ...] = ()) -> DataFrame:
    """``run, query_id, rank, evidence_id`` of kept runs, if their protocols are theirs and agree in ``must_agree``.

    A run that is unknown, unfinished, or kept under an identity that its protocol doesn't have is INDEX_INVALID,
    as are runs that differ in what must agree.
    """
    out, protocols = None, {}
    for run in runs:
        at = f"{root}/{run}"
        told = [r["inputs"] for r in spark.read.schema("inputs string").parquet(f"{at}/inputs").collect()] if exists(spark, f"{at}/inputs") else []
        made = sorted((r for r in _rows(spark, f"{at}/hits/log") if r["kind"] == "result"), key=lambda r: (r["at"], r["token"]))
        if len(set(told)) != 1 or identity_of(json.loads(told[0])) != run or not made:
            raise EngineError(Code.INDEX_INVALID, f"no finished run is kept as {run}")
        protocols[run] = json.loads(told[0])
        own = spark.read.parquet(f"{at}/hits/{made[0]['folder']}").select(F.lit(run).alias("run"), "query_id", "rank", "evidence_id")
        out = own if out is None else out.unionByName(own)
    for key in must_agree:
        if len({json.dumps(p.get(key), sort_keys=True) for p in protocols.values()}) > 1:
            raise EngineError(Code.INDEX_INVALID, f"the runs differ in {key}")
    return out


def labels_as_of(history: DataFrame, version: int) -> DataFrame:
    """``query_id, evidence_id, grade`` in force at ``version``: of each the last that is no newer; a null grade withdraws it."""
    last = history.where(F.col("version") <= version).groupBy("query_id", "evidence_id").agg(F.max_by("grade", "version").alias("grade"))
    return last.where("grade is not null")


def rescore(runs: DataFrame, history: DataFrame, version: int, depth: int = 8) -> DataFrame:
    """``run, query_id`` and the metrics of kept runs (see :func:`read_runs`) under the labels of a version.

    ``history``: query_id, evidence_id, grade, version. All runs are scored in one pass; a query that a run
    has nothing for counts as empty in it.
    """
    labels = labels_as_of(history, version)
    known = runs.select("run").distinct()
    key = F.struct("run", "query_id").alias("query_id")
    evidence = labels.join(F.broadcast(known)).select(key, "evidence_id", "grade")
    scored = score_evidence(runs.select(key, "rank", "evidence_id"), evidence, depth)
    return scored.select("query_id.run", "query_id.query_id", *[c for c in scored.columns if c != "query_id"])
