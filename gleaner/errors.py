"""Errors with stable codes."""

from __future__ import annotations

from enum import Enum


class Code(str, Enum):
    ARGUMENT_INVALID = "ARGUMENT_INVALID"
    CONFIG_INVALID = "CONFIG_INVALID"
    INDEX_NOT_READY = "INDEX_NOT_READY"
    INDEX_INVALID = "INDEX_INVALID"
    INDEX_INCOMPATIBLE = "INDEX_INCOMPATIBLE"
    INDEX_WRITE_FAILED = "INDEX_WRITE_FAILED"
    INDEX_BUSY = "INDEX_BUSY"
    SOURCE_INVALID = "SOURCE_INVALID"
    QUERY_TOO_LARGE = "QUERY_TOO_LARGE"
    EMBEDDING_FAILED = "EMBEDDING_FAILED"
    EXPANSION_FAILED = "EXPANSION_FAILED"
    RERANK_FAILED = "RERANK_FAILED"
    SEARCH_TIMEOUT = "SEARCH_TIMEOUT"
    INTERNAL_ERROR = "INTERNAL_ERROR"


class EngineError(Exception):
    def __init__(self, code: Code, message: str):
        super().__init__(f"{code.value}: {message}")
        self.code = code
