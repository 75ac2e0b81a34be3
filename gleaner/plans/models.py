"""Calls of outside models as tables: requests go in, answers and attempts come out.

A stage of a search asks by a table of requests (``query_id, place, request, left``). ``left`` is what
remains of a query's time, in milliseconds: it goes from stage to stage with the query, so that a slow
stage uses up the next one's time, and needs no clock that machines share. What is asked is
written once, with each answer, its error and its attempts in one row, and then split: the search
reads the answers, accounting the attempts, a record both.

:class:`Live` calls providers inside tasks. :class:`Replayed` takes the answers from a record by a
join on the digest of the request and its ordinal, so each answer is used once on any partitioning,
and by anti-joins both ways tells what was not answered and what was not used.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.errors import Code, EngineError
from gleaner.operators.numbering import numbered
from gleaner.session import materialise
from gleaner.sources.limits import Passing
from gleaner.sources.providers import Embedding, Expansion, Rerank

REQUESTS = "query_id long, place int, request string, left double"
CALLS = "array<struct<outcome:string,elapsed_ms:double,cost:double>>"
ASKED = f"{REQUESTS}, answer string, error string, calls {CALLS}"
RECORD = "kind string, digest string, ordinal long, request string, answer string"
#: Attempts of a call in a search, the shortest wait between them and the longest attempt, in
#: milliseconds, and bytes of an answer.
ATTEMPTS, LEAST_WAIT, LONGEST_ATTEMPT, ANSWER_BYTES = 2, 250.0, 10_000.0, 2 << 20
FAILURES = {"expand": Code.EXPANSION_FAILED, "embed": Code.EMBEDDING_FAILED, "rerank": Code.RERANK_FAILED}


class Models(Protocol):
    """What a search asks: ``size`` is that of vectors."""

    size: int

    def ask(self, kind: str, requests: DataFrame) -> DataFrame:
        """``query_id, place, request, left, answer, error`` for ``requests``, stored."""

    def finish(self) -> None:
        """Called after the last question."""


@dataclass
class Outcome:
    answer: Any = None
    error: str | None = None
    left: float = 0.0
    calls: list[dict] = field(default_factory=list)


@dataclass
class Caller:
    """One call within the time that is left: failures that may pass are tried again.

    An attempt ends after ``longest`` or with the time that is left, whatever the provider does. A wait
    that doesn't fit into the time ends the call; so does an answer of too many bytes. Costs
    that are not a finite number of at least zero are unknown, which is null.
    """

    kind: str
    cost: Callable[[str, Any], float | None] = lambda kind, answer: None
    attempts: int = ATTEMPTS
    longest: float = LONGEST_ATTEMPT
    bytes: int = ANSWER_BYTES
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def call(self, function: Callable[..., Any], *args: object, left: float) -> Outcome:
        out = Outcome(left=left)
        end = self.clock() + left / 1000
        remaining = lambda: (end - self.clock()) * 1000
        for k in range(self.attempts):
            if remaining() <= 0:
                break
            began, wait = self.clock(), LEAST_WAIT
            row = {"outcome": "FAILED", "elapsed_ms": 0.0, "cost": None}
            out.calls.append(row)
            pool = ThreadPoolExecutor(1)
            try:
                out.answer = pool.submit(function, *args).result(min(self.longest, remaining()) / 1000)
                row["outcome"] = "ANSWERED"
            except Late:
                row["outcome"] = "LATE"
            except Passing as failure:
                wait = max(wait, (failure.after or 0.0) * 1000)
            except Exception:
                out.error = FAILURES[self.kind].value
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
                row["elapsed_ms"] = (self.clock() - began) * 1000
            if row["outcome"] == "ANSWERED":
                found = self.cost(self.kind, out.answer)
                row["cost"] = float(found) if isinstance(found, (int, float)) and not isinstance(found, bool) and 0 <= found < float("inf") else None
                if len(json.dumps(out.answer).encode()) > self.bytes:
                    out.answer, out.error = None, FAILURES[self.kind].value
            if row["outcome"] == "ANSWERED" or out.error:
                break
            if k + 1 == self.attempts or wait >= remaining() > 0:
                out.error = FAILURES[self.kind].value
                break
            if remaining() > 0:
                self.sleep(wait / 1000)
        out.left = max(0.0, remaining())
        if not out.left:
            out.answer, out.error = None, Code.SEARCH_TIMEOUT.value
        return out


def runs(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows of one query that follow one another."""
    held: list[dict] = []
    for row in rows:
        if held and held[-1]["query_id"] != row["query_id"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.struct([("outcome", pa.string()), ("elapsed_ms", pa.float64()), ("cost", pa.float64())]))]
_NAMES = [c.split()[0] for c in f"{REQUESTS}, answer string, error string, calls x".split(", ")]


class Live:
    """Models that are called inside tasks; everything asked is kept in :attr:`asked`.

    A request for vectors is a text, one for a reranking ``{"query", "documents"}`` as JSON. Texts of one
    query go in one call.
    """

    def __init__(self, embedding: Embedding, expansion: Expansion, reranking: Rerank, cost: Callable[[str, Any], float | None] | None = None, **bounds):
        self.embedding, self.expansion, self.reranking, self.size = embedding, expansion, reranking, embedding.size
        self.bounds = bounds | ({"cost": cost} if cost else {})
        self.asked: dict[str, DataFrame] = {}

    def ask(self, kind: str, requests: DataFrame) -> DataFrame:
        caller, embedding, expansion, reranking = Caller(kind, **self.bounds), self.embedding, self.expansion, self.reranking

        def one(rows: list[dict]) -> list[tuple]:
            left = min(r["left"] for r in rows)
            if kind == "embed":
                found = caller.call(embedding.embed, [r["request"] for r in rows], left=left)
                short = found.error is None and (not isinstance(found.answer, list) or len(found.answer) != len(rows))
                error = FAILURES[kind].value if short else found.error
                answers = [None] * len(rows) if error else found.answer
            elif kind == "expand":
                found = caller.call(expansion.expand, rows[0]["request"], left=left)
                error, answers = found.error, [found.answer]
            else:
                request = json.loads(rows[0]["request"])
                found = caller.call(reranking.rerank, request["query"], request["documents"], left=left)
                error, answers = found.error, [found.answer]
            return [(r["query_id"], r["place"], r["request"], found.left, None if error else json.dumps(a), error, found.calls if not k else []) for k, (r, a) in enumerate(zip(rows, answers))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                for group in runs(rows) if kind == "embed" else ([r] for r in rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*one(group)), _KINDS)], _NAMES)

        names = [c.split()[0] for c in REQUESTS.split(", ")]
        self.asked[kind] = materialise(requests.select(*names).mapInArrow(run, ASKED), f"asked-{kind}")
        return self.asked[kind].drop("calls")

    def finish(self) -> None:
        pass

    def attempts(self) -> DataFrame:
        """``query_id, kind, attempt, outcome, elapsed_ms, cost`` of every call of every stage so far."""
        out = None
        for kind, asked in self.asked.items():
            own = asked.select("query_id", F.lit(kind).alias("kind"), "place", F.posexplode("calls").alias("attempt", "c")).select("query_id", "kind", "place", "attempt", "c.*")
            out = own if out is None else out.unionByName(own)
        return out

    def record(self) -> DataFrame:
        """What was answered, to be replayed: ``kind, digest, ordinal, request, answer``."""
        out = None
        for kind, asked in self.asked.items():
            own = keyed(kind, asked.where("error is null")).select("kind", "digest", "ordinal", "request", "answer")
            out = own if out is None else out.unionByName(own)
        return out


def digest_of(kind: str, request: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), request), 256)


def keyed(kind: str, requests: DataFrame) -> DataFrame:
    """``requests`` with ``kind, digest, ordinal``: equal requests are told apart by their number, in the
    order of query and place. A global order numbers them, so that a request that all queries share is no group."""
    rows = requests.withColumn("kind", F.lit(kind)).withColumn("digest", digest_of(kind, F.col("request")))
    rows = numbered(rows, ["digest", "query_id", "place"])
    first = rows.groupBy("digest").agg(F.min("number").alias("first"))
    return rows.join(first, "digest").withColumn("ordinal", F.col("number") - F.col("first")).drop("number", "first")


def misses(kind: str, requests: DataFrame, record: DataFrame) -> DataFrame:
    """``rule, digest, ordinal``: requests (keyed) without an answer, and answers that nothing asked for."""
    own = record.where(F.col("kind") == kind)
    key = ["digest", "ordinal"]
    absent = requests.join(own, key, "left_anti").select(F.lit("request without answer").alias("rule"), *key)
    return absent.unionByName(own.join(requests, key, "left_anti").select(F.lit("answer without request").alias("rule"), *key))


class Replayed:
    """Answers taken from a record (``kind, digest, ordinal, request, answer``), each once."""

    def __init__(self, record: DataFrame, size: int):
        self.record_table, self.size = record, size
        self.keyed: dict[str, DataFrame] = {}

    def ask(self, kind: str, requests: DataFrame) -> DataFrame:
        asked = materialise(keyed(kind, requests), f"replayed-{kind}")
        self.keyed[kind] = asked
        own = self.record_table.where(F.col("kind") == kind).select("digest", "ordinal", "answer")
        if own.groupBy("digest", "ordinal").count().where("count > 1").limit(1).count():
            raise EngineError(Code.INTERNAL_ERROR, f"the record has an answer for {kind} twice")
        found = asked.join(own, ["digest", "ordinal"], "left")
        lost = found.where("answer is null").limit(1).collect()
        if lost:
            raise EngineError(Code.INTERNAL_ERROR, f"no recorded answer is left for {kind} of query {lost[0]['query_id']}")
        return found.select("query_id", "place", "request", "left", "answer", F.lit(None).cast("string").alias("error"))

    def violations(self) -> DataFrame:
        """``kind, rule, digest, ordinal`` of whatever doesn't match, kinds that were never asked included."""
        out = None
        for kind in FAILURES:
            asked = self.keyed.get(kind)
            own = misses(kind, asked if asked is not None else self.record_table.where("false"), self.record_table).select(F.lit(kind).alias("kind"), "rule", "digest", "ordinal")
            out = own if out is None else out.unionByName(own)
        return out

    def finish(self) -> None:
        if self.violations().limit(1).count():
            raise EngineError(Code.INTERNAL_ERROR, "a recorded answer was not used")
