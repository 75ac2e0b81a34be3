import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.bpe import BytePairs, decode_documents, encode_documents
from tests.llm.texts import awkward, frame

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return BytePairs.from_file(PATH, PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(data):
    return [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]


def test_every_token_has_its_merge(own):
    assert all(len(t) == 1 or own.merged[own.halves[k]] == k for k, t in enumerate(own.tokens))
    assert all(own.merge(t) == [k] for k, t in enumerate(own.tokens))


def test_texts(own, other):
    own.known.clear()
    for text in ["", "a" * 20000, "ab" * 9000, "\n" * 3000 + " x", "é" * 3000, "<|endoftext|>", "\x1c\x85  x  ", "it's 3½ ٣", "ÃÂ" * 500, *[t for _, t in awkward() if t]]:
        found = own.encode(text)
        assert ids(found) == other.encode_ordinary(text)
        assert own.decode(found) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, other, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(own.encode(text)) == other.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_any_bytes(own, other, piece):
    assert own.merge(piece) == other._core_bpe.encode_single_piece(piece)


def test_full_memo(own, other, monkeypatch):
    from gleaner.llm import bpe

    monkeypatch.setattr(bpe, "PIECE_MEMO", 0)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 3)
    fresh = BytePairs(own.ranks, PATTERN)
    assert ids(fresh.encode("some words, unseen before")) == other.encode_ordinary("some words, unseen before")
    assert not fresh.known


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        BytePairs({b"a": 0}, PATTERN)


def test_documents(spark, other):
    rows = awkward()
    found = decode_documents(encode_documents(frame(spark, rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], ids(bytes(r["ids"])), bytes(r["decoded"])) for r in found) == sorted((repr(d), len(w := other.encode_ordinary(t or "")), w, (t or "").encode()) for d, t in rows)
    assert encode_documents(frame(spark, []), PATH, PATTERN).count() == 0
