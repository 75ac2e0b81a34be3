import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.errors import EngineError
from gleaner.sources import markdown
from gleaner.sources.markdown import Budget, context, passages, scan_tree
from gleaner.sources.providers import HashEmbedding, anchors, check_expansion, check_scores, check_vectors, contains_literal


def tiles(text, spans):
    whole = markdown.normalise(text)
    at = 0
    for s in spans:
        assert s["start"] == at and s["end"] == at + len(s["text"]) and (s["passage_id"] is None) == (not s["text"].strip())
        at = s["end"]
    assert at == len(whole) and "".join(s["text"] for s in spans) == whole


def headings(text):
    spans = passages("p", "s.md", text)
    tiles(text, spans)
    return [s["headings"] for s in spans if s["passage_id"]]


def test_headings():
    text = "\r\npreamble é 😀\r\n\r\nTitle\r\n=====\r\nbody\r\n\r\n## Child\r\ntext\r\n\r\n## Empty\r\n"
    assert headings(text) == [[], ["Title"], ["Title", "Child"], ["Title", "Empty"]]
    assert headings("﻿# Heading\r\nPolish dokument.\r\n## Child\r\nBody") == [["Heading"], ["Heading", "Child"]]
    assert headings("# A ##\n### C\nx\n## B\ny\n# D\n#x\n####### y") == [["A"], ["A", "C"], ["A", "B"], ["D"]]
    assert headings("```\n# no\n~~~\n# no\n```\n# yes\nx") == [[], ["yes"]]
    assert headings("    # indented\n\n- - -\ntitle\n---\nx") == [[], ["title"]]
    assert headings("") == [] and headings(" \n\t\n") == []


def test_code_stays_whole():
    text = "# Setup\n\n```ts\n" + "# not a heading\n" + "line of code();\n" * 100 + "```\n\nafter"
    spans = passages("p", "s.md", text)
    tiles(text, spans)
    assert any("```ts" in s["text"] and "();\n```\n" in s["text"] for s in spans)


def test_long_texts_are_cut():
    for text in ("```\n" + "界😀é " * 4000 + "\n```", " documentation" * 1800, "x" * 9000, "line\n" * 3000):
        spans = passages("p", "s.md", text)
        tiles(text, spans)
        assert len(spans) > 3
        head = context("p", "s.md", [], Budget())
        assert all(Budget().fits(head + s["text"]) for s in spans)


def test_identities():
    a, b = passages("p", "s.md", "same text"), passages("p", "s.md", "\nsame text")
    assert a[0]["chunk_hash"] == b[-1]["chunk_hash"] or a[0]["text"] != b[-1]["text"]
    assert a[0]["passage_id"] != b[-1]["passage_id"]
    assert (a[0]["start_line"], b[-1]["end_line"]) == (1, 2)


def test_context_is_bounded():
    long = context("p", "a/" * 500 + "end.md", ["h" * 1000, "k"], Budget())
    assert len(long.encode()) <= markdown.CONTEXT and "end.md" in long


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #=-`~\n\t 界\r", max_size=200))
def test_any_text_is_tiled(text):
    tiles(text, passages("p", "s.md", text))


def test_coverage_notices_a_loss(spark):
    sources = spark.createDataFrame([("a", "# x\n\ntext"), ("b", ""), ("c", None)], "source string, text string")
    spans = markdown.chunk(sources)
    assert {(r["source"], r["ok"]) for r in markdown.coverage(spans, sources).collect()} == {("a", True), ("b", True), ("c", True)}
    broken = spans.where("start > 0")
    assert {r["source"] for r in markdown.coverage(broken, sources).where("not ok").collect()} <= {"a"}


def test_scan(spark, tmp_path):
    for name, data in {".agent/knowledge/a b+é.md": b"one", ".agent/decisions/d/x.md": "﻿# two".encode(), ".agent/knowledge/node_modules/n.md": b"no", ".agent/other/o.md": b"no", ".agent/knowledge/t.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {(r["source"], r["text"]) for r in scan_tree(spark, str(tmp_path)).collect()}
    assert found == {(".agent/knowledge/a b+é.md", "one"), (".agent/decisions/d/x.md", "﻿# two")}
    (tmp_path / ".agent/knowledge/bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        scan_tree(spark, str(tmp_path)).collect()


QUERY = "Czy `initialConfig` w docs/setup.md ma --cache, user_id i 25%?"
VALID = "initialConfig docs/setup.md --cache user_id 25%"


def test_expansions():
    assert check_expansion(QUERY, {"lex": [VALID], "vec": [], "hyde": []})["lex"] == [VALID]
    for old, new in (("initialConfig", "initialConfigX"), ("--cache", "--cached"), ("docs/setup.md", "other/docs/setup.md"), ("user_id", "USER_ID"), ("25%", "125%"), ("25%", "25% inventedPath"), ("25%", "25% --invented"), ("25%", "25% fake.md")):
        with pytest.raises(EngineError):
            check_expansion(QUERY, {"lex": [VALID.replace(old, new)], "vec": [], "hyde": []})
    for query, text, good in (("Use 1,5 seconds?", "Use 1 and 5 seconds", False), ("config.json", "config.json.backup", False), ("Explain search", "How Does Search Work", True), ("Use `exact value`", "Use `other value`", False)):
        if good:
            check_expansion(query, {"lex": [text], "vec": [], "hyde": []})
        else:
            with pytest.raises(EngineError):
                check_expansion(query, {"lex": [text], "vec": [], "hyde": []})
    assert check_expansion("q", {"lex": [" x ", "x"], "vec": ["q"], "hyde": ["q"]}) == {"lex": ["x"], "vec": [], "hyde": ["q"]}
    for bad in ({"lex": []}, {"lex": ["a"] * 3, "vec": [], "hyde": []}, {"lex": ["a\nb"], "vec": [], "hyde": []}, {"lex": [1], "vec": [], "hyde": []}, {"lex": ["?"], "vec": [], "hyde": []}, {"lex": [], "vec": [], "hyde": ["w " * 41]}, None):
        with pytest.raises(EngineError):
            check_expansion("q", bad)
    assert "25%" in anchors(QUERY) and "user_id" in anchors(QUERY) and contains_literal("a x.y b", "x.y") and not contains_literal("ax.y", "x.y")


def test_answers_are_checked():
    e = HashEmbedding(8)
    assert check_vectors(["a"], e.embed(["a"]), 8) == check_vectors(["a"], e.embed(["a"]), 8)
    for bad in ([], [[0.0] * 8], [[float("nan")] * 8], [[1.0] * 7]):
        with pytest.raises(EngineError):
            check_vectors(["a"], bad, 8)
    with pytest.raises(EngineError):
        check_scores(["a"], [float("inf")])


@pytest.mark.parametrize("text", ["foo-bar", "a.foo", "x@foo", "a/foo", "k:foo", "foo/a", "foo@x", "foo.a", "foo:k", "foo_", "9foo"])
def test_a_literal_inside_another_one_does_not_count(text):
    assert not contains_literal(f"see {text} here", "foo")


@pytest.mark.parametrize("text", ["foo", "(foo)", "`foo`", "foo.", "foo: bar", "foo, bar", "say: foo!", "a.foo foo"])
def test_a_literal_for_itself_counts(text):
    assert contains_literal(text, "foo")


@pytest.mark.parametrize(
    "query, want",
    [
        ("Why std::vector, not foo:-x or timeout:+5.", ["std::vector", "foo:-x", "timeout:+5"]),
        ("Read docs/a.md: set --cache and -v", ["docs/a.md", "--cache", "-v"]),
        ("UTF-8 1E+3 HTTP2 5ms 1.2.3 2026-09-06 12:30", ["UTF-8", "1E+3", "HTTP2", "5ms", "1.2.3", "2026-09-06", "12:30"]),
        ("25% or 3,5 or -1.", ["25", "25%", "3", "3,5", "5", "-1"]),
        ("`two words` in initialConfig, XMLReader", ["two words", "initialConfig", "XMLReader"]),
        ("How Does Search Work in NATO or U.S.?", ["U.S"]),
        ("plain words. end:", []),
    ],
)
def test_which_literals_are_kept(query, want):
    assert anchors(query) == want


@pytest.mark.parametrize(
    "query, variant, good",
    [
        ("Explain std::string.", "Find documentation about std::string", True),
        ("Explain std::string.", "Explain std::vector", False),
        ("Explain timeout:-5.", "Explain timeout:5", False),
        ("config.json", "config.json.backup", False),
        ("Use 1,5 seconds?", "Use 1 and 5 seconds", False),
        ("Use `exact value`", "Use `other value`", False),
        ("Explain search", "How Does Search Work", True),
        ("Explain search", "Explain inventedPath", False),
        ("Keep 25%:", "Keep it", False),
    ],
)
def test_variants_keep_literals(query, variant, good):
    answer = {"lex": [variant], "vec": [], "hyde": []}
    if good:
        assert check_expansion(query, answer)["lex"] == [variant]
    else:
        with pytest.raises(EngineError, match="EXPANSION_FAILED"):
            check_expansion(query, answer)
