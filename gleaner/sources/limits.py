"""Budgets of requests and retries, around any provider."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from gleaner.errors import Code, EngineError
from gleaner.sources.markdown import Budget

#: Budgets of a query, of a reranked document and of a request.
QUERY_TOKENS, QUERY_BYTES = 2048, 16_384
DOCUMENT_TOKENS, DOCUMENT_BYTES, PAIR_TOKENS = 4096, 32_768, 6144
DOCUMENTS, REQUEST_TOKENS, REQUEST_BYTES = 40, 245_760, 2 << 20
INSTRUCTION = "Instruct: Given a question about project documentation, retrieve relevant passages that answer the question\nQuery: "
ATTEMPTS, SECONDS = 4, 120.0


def _json_bytes(value: object) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))


def format_query(question: str, budget: Budget = Budget(), instruction: str = "") -> str:
    """What is embedded for a question, or QUERY_TOO_LARGE."""
    if not question.strip() or _json_bytes(question) > QUERY_BYTES or budget.soft(question) > QUERY_TOKENS or budget.hard(instruction + question) > QUERY_BYTES:
        raise EngineError(Code.QUERY_TOO_LARGE, "a query has words, and stays within its budget")
    return instruction + question


def check_request(query: str, documents: list[str], count: Callable[[str], int] = Budget().soft) -> list[str]:
    """The documents of a reranking, or RERANK_FAILED if the request is over a budget."""
    format_query(query)
    own = count(query)
    tokens = [count(d) for d in documents]
    if not 0 < len(documents) <= DOCUMENTS or any(not d or _json_bytes(d) > DOCUMENT_BYTES for d in documents):
        raise EngineError(Code.RERANK_FAILED, "between 1 and 40 documents, none empty or too large, are reranked")
    if max(tokens) > DOCUMENT_TOKENS or max(tokens) + own > PAIR_TOKENS or own * len(documents) + sum(tokens) > REQUEST_TOKENS or _json_bytes([query, documents]) > REQUEST_BYTES:
        raise EngineError(Code.RERANK_FAILED, "the request is over its budget of tokens")
    return documents


class Passing(Exception):
    """A failure that may pass: what a provider raises for a lost connection, 429 or a server error."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass
class Retrying:
    """Calls again after failures that may pass, within bounds of attempts and time.

    Waits one second, doubled each time, or as long as the failure says if that is longer.
    """

    attempts: int = ATTEMPTS
    seconds: float = SECONDS
    code: Code = Code.EMBEDDING_FAILED
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def call(self, function: Callable[..., Any], *args: object) -> Any:
        end = self.clock() + self.seconds
        for k in range(self.attempts):
            try:
                return function(*args)
            except Passing as failure:
                wait = max(2.0**k, failure.after or 0.0)
                if k + 1 == self.attempts or self.clock() + wait > end:
                    raise EngineError(self.code, f"no answer after {k + 1} attempts") from failure
                self.sleep(wait)
