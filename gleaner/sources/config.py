"""The settings of a project: its name and its models."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from gleaner.errors import Code, EngineError

#: Fixed value: where a project keeps its settings.
PATH = ".agent/memory.json"


@dataclass(frozen=True)
class Config:
    project: str
    embedding: str
    retrieval: str | None = None


def _one_line(value: object) -> bool:
    """Whether a setting is text on one line with more than white space in it."""
    return isinstance(value, str) and bool(value.strip()) and not set(value) & set("\r\n\0") and not any(0xD800 <= ord(c) < 0xE000 for c in value)


def _model(settings: dict, name: str) -> str:
    own = settings.get(name)
    if not isinstance(own, dict) or not _one_line(own.get("model")):
        raise EngineError(Code.CONFIG_INVALID, f"{name} names no model")
    return own["model"]


def parse_config(text: str) -> Config:
    """The settings in a JSON text; others than these are left out. What is missing or odd is CONFIG_INVALID."""
    try:
        settings = json.loads(text)
    except ValueError as failure:
        raise EngineError(Code.CONFIG_INVALID, "the settings are not JSON") from failure
    if not isinstance(settings, dict) or not _one_line(settings.get("project")):
        raise EngineError(Code.CONFIG_INVALID, "the settings name no project")
    return Config(settings["project"], _model(settings, "embedding"), _model(settings, "retrieval") if "retrieval" in settings else None)


def read_config(spark: SparkSession, root: str) -> Config:
    """The settings below ``root``, in any store."""
    try:
        rows = spark.read.text(f"{root}/{PATH}", wholetext=True).limit(2).collect()
    except AnalysisException as failure:
        raise EngineError(Code.CONFIG_INVALID, f"there is no {PATH}") from failure
    if len(rows) != 1:
        raise EngineError(Code.CONFIG_INVALID, f"{PATH} is not one file")
    return parse_config(rows[0]["value"])
