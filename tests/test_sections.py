"""Sections by windows over lines, against the sequential form, one text after another."""

import random

import duckdb
import pytest

from gleaner.operators.sections import lines, sections
from gleaner.plans import queries as library
from gleaner.sources import markdown
from gleaner.sources.markdown import chunk, passages

PIECES = ["# a", "## b ##", "### c", "#", "###### f", "####### g", "text", "===", "---", "  ---  ", "    ind", "\tind", "", "   ", "```", "````", "~~~", "```py", "``` a`b", "~~~~ x", "   ```", "    ```", "t u", "# t u", "\xa0", "#\tq # #", "﻿# z", "---　", "#  #", "é𝄞 x", "~~~ ", "-"]


def plain(text):
    text = markdown.normalise(text or "")
    bounds, found = markdown._laid_out(text)
    return [(bounds[a], a, headings, text[bounds[a] : bounds[b]]) for a, b, headings in markdown.sections(found)]


def by_windows(spark, rows):
    out = {}
    for r in sections(spark.createDataFrame(rows, "source string, text string, at long, key string, body string"), "source", "text").collect():
        out.setdefault(r["source"], []).append((r["start"], r["line"], r["headings"], r["body"]))
    return {k: sorted(v) for k, v in out.items()}


def made(rnd, k):
    text = "".join(rnd.choice(PIECES) + rnd.choice(["\n"] * 6 + ["\r\n", "\r"]) for _ in range(rnd.randint(0, 14)))
    return (("﻿" if rnd.random() < 0.05 else "") + (text[:-1] if rnd.random() < 0.5 else text), k)


def test_sections_are_those_of_a_walk_through_the_lines(spark):
    rnd = random.Random(3)
    rows = [(str(k), made(rnd, k)[0], 7, "k", None) for k in range(3000)]
    found = by_windows(spark, rows)
    for source, text, *_ in rows:
        assert found.get(source, []) == plain(text), text


def test_null_empty_and_marked_texts(spark):
    rows = [(k, text, None, None, None) for k, text in {"null": None, "empty": "", "mark": "﻿", "marked": "﻿# a\nb", "fenced": "﻿```\n# a\n```\n# b"}.items()]
    found = by_windows(spark, rows)
    assert set(found) == {"mark", "marked", "fenced"}
    assert found["marked"] == [(0, 0, ["a"], "﻿# a\nb")]
    assert [x[2] for x in found["fenced"]] == [[], ["b"]]
    assert by_windows(spark, []) == {}


def test_very_long_fences_and_texts(spark):
    text = "x\n```\n" + "inside\n" * 60_000 + "```\n# after\n" + "y z\n" * 30_000 + "```\n# never\n" * 1 + "# no\n" * 20_000
    assert by_windows(spark, [("a", text, 1, "", "")])["a"] == plain(text)
    many = "```\n# no\n```\n# yes\n" * 5_000
    assert by_windows(spark, [("a", many, 1, "", "")])["a"] == plain(many)


def test_a_fence_is_one_row(spark):
    rows = lines(spark.createDataFrame([("a", "x\n```\n# a\n```\ny")], "source string, text string")).orderBy("at").collect()
    assert [(r["piece"], r["fenced"]) for r in rows] == [("x\n", False), ("```\n# a\n```\n", True), ("y", False)]


def test_chunks_are_the_passages_of_each_text(spark):
    rnd = random.Random(8)
    rows = [(f"s{k}", "".join(made(rnd, k)[0] + "\n" + "word " * rnd.choice([0, 3, 900]) for _ in range(4))) for k in range(200)] + [("long", "y z\n\n" * 20_000)]
    found = {}
    for r in chunk(spark.createDataFrame(rows, "source string, text string")).collect():
        found.setdefault(r["source"], []).append(r.asDict())
    for source, text in rows:
        assert sorted(found[source], key=lambda r: r["start"]) == passages("project", source, text)


def test_sql_walks_awkward_markdown_too(spark, tmp_path):
    rnd = random.Random(21)
    docs = [(k, made(rnd, k)[0], "s") for k in range(400)] + [(900, None, "s"), (901, "", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, k, "user", made(rnd, k)[0]) for k in range(40)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = library.markdown_sections(spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({library.MARKDOWN_SECTIONS})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert any(" > " in r[3] for r in want)


@pytest.mark.parametrize("text", ["﻿# ﻿title﻿\n", "title\xa0\n===\n"])
def test_titles_are_trimmed(text):
    assert plain(text)[-1][2] == ["title"]
