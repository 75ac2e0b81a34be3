"""Markdown sources: scanning a tree, and cutting texts losslessly into passages.

Sections come from windows over lines (``operators/sections.py``); token budgets within a section are
sequential, so they are an Arrow function over sections, which Spark deals to tasks. Spans tile
the text: every character is in exactly one passage or one span of white space.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleaner.errors import Code, EngineError
from gleaner.functions.text import JS_SPACE
from gleaner.operators import sections as by_lines

ROOTS = (".agent/knowledge", ".agent/decisions")
SKIPPED = (".git", "node_modules", "dist", "build", ".env")
#: Soft and hard budgets of a passage, longest piece tried, budget of its context.
SOFT, HARD, JSON_BYTES, PIECE, CONTEXT = 500, 2048, 32768, 16000, 256

_SPACE = JS_SPACE.encode().decode("unicode_escape")
_BLANK = re.compile(f"{_SPACE}*\\Z")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)\Z", re.S)
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+([^\n\r\u2028\u2029]*?)|[ \t]*)\Z")
_SETEXT = re.compile(f" {{0,3}}(=+|-+){_SPACE}*\\Z")
_INDENTED = re.compile(r"(?: {4}|\t)")
_EDGES = re.compile(f"\\A{_SPACE}+|{_SPACE}+\\Z")


def _refuse_links(root: str) -> None:
    """Links are followed by Spark's readers, so a local tree is looked through first."""
    scheme, told, rest = root.partition("://")
    if told and scheme != "file":
        return
    base = Path(rest if told else root)
    todo = [base / folder for folder in ROOTS]
    if any(p.is_symlink() for p in {base / ".agent", *todo}):
        raise EngineError(Code.SOURCE_INVALID, "a symbolic link among the sources")
    while todo:
        folder = todo.pop()
        if not folder.is_dir():
            continue
        for entry in os.scandir(folder):
            if entry.name in SKIPPED or entry.name.startswith(".env."):
                continue
            if entry.is_symlink():
                raise EngineError(Code.SOURCE_INVALID, f"a symbolic link among the sources: {entry.path}")
            if entry.is_dir():
                todo.append(Path(entry.path))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``source, text`` of the Markdown files below the two roots; invalid UTF-8 is an error.

    A byte-order mark stays in the text. Hidden, build and dependency folders are left out. A symbolic
    link is SOURCE_INVALID, where the store has such.
    """
    _refuse_links(root)
    files = None
    for folder in ROOTS:  # loaded by name, since Spark leaves out folders whose names begin with a dot
        try:
            own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{root}/{folder}").select("path", "content")
        except AnalysisException:
            continue
        files = own if files is None else files.unionByName(own)
    if files is None:
        return spark.createDataFrame([], "source string, text string")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^.*?/(?=\.agent/(?:knowledge|decisions)/)", "")
    wanted = path.rlike(r"^\.agent/(knowledge|decisions)/") & ~F.exists(F.split(path, "/"), lambda x: x.isin(*SKIPPED) | x.startswith(".env."))
    found = files.select(path.alias("source"), "content").where(wanted)
    return found.select("source", F.validate_utf8(F.col("content").cast("string")).alias("text"))


# Budgets


@dataclass(frozen=True)
class Budget:
    """Counts tokens. The default counts bytes, and estimates soft tokens as a fourth of them."""

    name: str = "utf8-bytes"
    soft: Callable[[str], int] = lambda text: -(-len(text.encode()) // 4)
    hard: Callable[[str], int] = lambda text: len(text.encode())

    def fits(self, whole: str) -> bool:
        if self.hard(whole) > HARD:
            return False
        # a character takes six bytes of JSON at most
        return 6 * len(whole) + 2 <= JSON_BYTES or len(json.dumps(whole, ensure_ascii=False).encode()) <= JSON_BYTES


def context(project: str, source: str, headings: list[str], budget: Budget) -> str:
    """What is put before a passage's text: project, path and headings as JSON.

    Over budget, the longest entry is halved again and again, paths keeping their ends.
    """
    entries = [project, source, *headings]

    def shown() -> str:
        return f"Context: {json.dumps(entries, ensure_ascii=False, separators=(',', ':'))}\n\n"

    if budget.hard(shown()) > CONTEXT:
        mark = hashlib.sha256(shown().encode()).hexdigest()[:16]
        entries.append(mark)
        while budget.hard(shown()) > CONTEXT:
            k = max(range(len(entries) - 1), key=lambda i: len(entries[i]))
            half = len(entries[k]) // 2
            if not half and not entries[k]:
                break
            entries[k] = entries[k][len(entries[k]) - half :] if k == 1 else entries[k][:half]
    return shown()


# Cutting


def normalise(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


class Fence:
    """Whether a line is inside a fenced block, fed line by line."""

    def __init__(self) -> None:
        self.open: str | None = None

    def feed(self, line: str) -> bool:
        """Whether the line belongs to a fenced block."""
        m = _FENCE.match(line)
        if self.open is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                self.open = m[1]
                return True
            return False
        if m and m[1][0] == self.open[0] and len(m[1]) >= len(self.open) and _BLANK.match(m[2]):
            self.open = None
        return True


def sections(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """``(first line, line after, headings)``; ``lines`` without their line ends."""
    out, stack, fence, start, at = [], [], Fence(), 0, 0
    while at < len(lines):
        line = lines[at].removeprefix("\ufeff") if at == 0 else lines[at]
        inside = fence.feed(line)
        title, level, taken = None, 0, 1
        if not inside:
            if m := _ATX.match(line):
                level, title = len(m[1]), _EDGES.sub("", re.sub(r"(?:^|[ \t]+)#+[ \t]*\Z", "", m[2] or ""))
            elif at + 1 < len(lines) and not _BLANK.match(line) and not _INDENTED.match(line) and (m := _SETEXT.match(lines[at + 1])):
                level, title, taken = (1 if m[1][0] == "=" else 2), _EDGES.sub("", line), 2
        if title is not None:
            if at > start:
                out.append((start, at, [t for _, t in stack]))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            start = at
        at += taken
    out.append((start, len(lines), [t for _, t in stack]))
    return [x for x in out if x[1] > x[0]]


def blocks(lines: list[str], first: int, after: int) -> list[tuple[int, int, bool]]:
    """``(first line, line after, code)``: a section's parts between blank lines outside fences."""
    out, fence, start, code = [], Fence(), first, False
    for at in range(first, after):
        fenced = fence.feed(lines[at])
        code = code or fenced or bool(_INDENTED.match(lines[at]))
        if fenced or not _BLANK.match(lines[at]):
            continue
        following = next((k for k in range(at + 1, after) if not _BLANK.match(lines[k])), None)
        if following is not None and _INDENTED.match(lines[start]) and _INDENTED.match(lines[following]):
            continue
        out.append((start, at + 1, code))
        start, code = at + 1, False
    if start < after:
        out.append((start, after, code))
    return out


def split_long(text: str, start: int, end: int, fits: Callable[[int, int], bool], small: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pieces of an oversize block: the longest that fit, cut back to a line end or white space."""
    out = []
    while start < end:
        if small(start, end) and fits(start, end):
            out.append((start, end))
            break
        low, high = 0, min(end - start, PIECE)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if small(start, start + mid) and fits(start, start + mid) else (low, mid - 1)
        size = low or 1
        if not low and not fits(start, start + 1):
            raise EngineError(Code.SOURCE_INVALID, "a passage of one character does not fit")
        piece = text[start : start + size]
        cut = piece.rfind("\n") + 1 or max((m.end() for m in re.finditer(_SPACE, piece)), default=0)
        if cut and fits(start, start + cut):
            size = cut
        out.append((start, start + size))
        start += size
    return out


def _laid_out(text: str) -> tuple[list[int], list[str]]:
    """Where each line of a text begins, with the end of the last, and the lines without their ends."""
    bounds = [0] + [m.end() for m in re.finditer("\n", text)]
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return bounds, [text[a:b].removesuffix("\n") for a, b in zip(bounds[:-1], bounds[1:])]


def cut(project: str, source: str, headings: list[str], body: str, start: int, line: int, budget: Budget) -> list[dict]:
    """The spans of one section: ``start`` characters and ``line`` lines of its text are before its ``body``."""
    bounds, lines = _laid_out(body)
    head = context(project, source, headings, budget)

    def fits(a: int, b: int) -> bool:
        return budget.fits(head + body[a:b])

    def small(a: int, b: int) -> bool:
        return budget.soft(head + body[a:b]) <= SOFT

    spans: list[tuple[int, int]] = []
    pending: tuple[int, int] | None = None
    for x, y, code in blocks(lines, 0, len(lines)):
        a, b = bounds[x], bounds[y]
        if pending and small(pending[0], b) and fits(pending[0], b):
            pending = (pending[0], b)
            continue
        if pending:
            spans.append(pending)
            pending = None
        if fits(a, b) and (code or small(a, b)):
            pending = (a, b)
        else:
            spans += split_long(body, a, b, fits, small)
    if pending:
        spans.append(pending)
    out = []
    for a, b in spans:
        own = body[a:b]
        blank = bool(_BLANK.match(own))
        key = json.dumps([source, start + a, start + b, hashlib.sha256(own.encode()).hexdigest()], ensure_ascii=False, separators=(",", ":"))
        out.append(
            {
                "source": source,
                "start": start + a,
                "end": start + b,
                "start_line": line + bisect_right(bounds, a),
                "end_line": line + bisect_right(bounds, max(a, b - 1)),
                "headings": headings,
                "text": own,
                "chunk_hash": None if blank else "sha256:" + hashlib.sha256((head + own).encode()).hexdigest(),
                "passage_id": None if blank else "sha256:" + hashlib.sha256(key.encode()).hexdigest(),
            }
        )
    return out


def passages(project: str, source: str, text: str, budget: Budget = Budget()) -> list[dict]:
    """The spans of one text in order: passages, and white space with a null ``passage_id``."""
    text = normalise(text)
    bounds, lines = _laid_out(text)
    return [span for first, after, headings in sections(lines) for span in cut(project, source, headings, text[bounds[first] : bounds[after]], bounds[first], first, budget)]


ARROW = pa.schema([("source", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("headings", pa.list_(pa.string())), ("text", pa.string()), ("chunk_hash", pa.string()), ("passage_id", pa.string())])
SCHEMA = "source string, start long, end long, start_line long, end_line long, headings array<string>, text string, chunk_hash string, passage_id string"


def chunk(sources: DataFrame, project: str = "project", budget: Budget = Budget()) -> DataFrame:
    """The spans of all ``sources`` (source, text), each source once. Null texts count as empty and give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                rows = [r for s in part for r in cut(project, s["source"], s["headings"], s["body"], s["start"], s["line"], budget)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return by_lines.sections(sources).select("source", "headings", "body", "start", "line").mapInArrow(run, SCHEMA)


def coverage(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, ok``: whether the spans of each source tile its text and give its hash again."""
    from gleaner.functions.text import lf

    ordered = spans.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("s"))
    ends = F.aggregate("s", F.lit(0).cast("long"), lambda at, x: F.when(x["start"] == at, x["end"]).otherwise(F.lit(-1).cast("long")))
    joined = F.concat_ws("", F.transform("s", lambda x: x["text"]))
    checked = ordered.select("source", ends.alias("ends"), joined.alias("joined"))
    whole = lf(F.coalesce("text", F.lit("")))
    both = sources.select("source", whole.alias("whole")).join(checked, "source", "left")
    return both.select("source", ((F.coalesce("ends", F.lit(0)) == F.length("whole")) & (F.coalesce("joined", F.lit("")) == F.col("whole"))).alias("ok"))
