"""Text expressions: tokens, hashes, positions, snippets. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, where it is split, where a capital begins a new part.
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}_./:@-]*[\p{L}\p{N}])?"
SEPARATORS = r"[_./:@-]+"
HUMP, ACRONYM = r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})"
#: What a text has where a match of it has several terms.
SPLITS = r"[\p{L}\p{N}](?:[_./:@-]+[\p{L}\p{N}]|\p{Lu})"
BASELINE_TOKEN = r"[\p{L}\p{N}_]+(?:[./:@-][\p{L}\p{N}_]+)*"
#: White space as JavaScript's regular expressions have it.
JS_SPACE = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

SNIPPET = 400


def matches(text: Column) -> Column:
    """The token matches of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def match_terms(match: Column) -> Column:
    """The distinct terms of one match, in lower case: the whole, its parts, and the parts' humps.

    A match without separator or capital is its own only term; most are, and need no splitting.
    """

    def humps(part: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(part, HUMP, "$1 $2"), ACRONYM, "$1 $2")
        return F.concat(F.array(F.lower(part)), F.transform(F.split(spaced, " "), F.lower))

    parts = F.flatten(F.transform(F.split(match, SEPARATORS), humps))
    every = F.array_distinct(F.concat(F.array(F.lower(match)), parts))
    return F.when(match.rlike(r"[_./:@-]|.\p{Lu}"), every).otherwise(F.array(F.lower(match)))


def terms(text: Column) -> Column:
    """All terms of a text; a term counts once for each match that has it.

    A text none of whose matches has a separator or an inner capital is told by one search, and its matches need no splitting.
    """
    found = matches(text)
    return F.when(text.rlike(SPLITS), F.flatten(F.transform(found, match_terms))).otherwise(F.transform(found, F.lower))


def baseline_normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def baseline_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(BASELINE_TOKEN), F.lit(0)))


def lf(text: Column) -> Column:
    """Line ends as single line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def source_hash(text: Column) -> Column:
    return digest(lf(text))


def passage_id(source: Column, start: Column, end: Column, body: Column) -> Column:
    """Identity of an occurrence: the digest of ``[source, start, end, digest of the body]`` as JSON.

    ``source`` must be a safe path, which JSON doesn't escape.
    """
    parts = F.concat(F.lit('["'), source, F.lit('",'), start.cast("string"), F.lit(","), end.cast("string"), F.lit(',"'), F.sha2(body, 256), F.lit('"]'))
    return digest(parts)


def knowledge_path(source: Column, doc_id: Column) -> Column:
    """The path under which a row of ``documents`` is a source."""
    return F.concat(F.lit(".agent/knowledge/"), source, F.lit("/"), doc_id.cast("string"), F.lit(".md"))


def safe_source(path: Column) -> Column:
    """Whether a path is a relative Markdown path below one of the two roots, without tricks."""
    clean = ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    return path.rlike(r"^\.agent/(knowledge|decisions)/[^\\\x00]+\.md$") & clean


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """The first ``size`` characters, marked by an ellipsis if there are more."""
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, F.lit("…")).otherwise(F.lit("")))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset: the floor join of offsets and line starts."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("long")


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a character offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long")
