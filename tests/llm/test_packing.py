import itertools
import random
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing, tasks
from gleaner.llm.packing import WordEncoder, best_fit, encoder, pack_documents, plan, reduce_by_dominance
from tests.llm.texts import awkward, frame, order

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_texts_do(plain):
    rnd = random.Random(3)
    letters = "abcXYZ  \t\n\r\x0b\x1c\x85 　 '’sdéÉİẞΣς中😀‍09٣½!?.,<|endoftext|>́﻿\x00"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [t for _, t in awkward()]
    e = WordEncoder(PATH)
    found = [x for at in range(0, len(texts), 100) for x in e.encode(texts[at : at + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain(t) for t in texts]


def test_full_memo(plain, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 0)
    e = WordEncoder(PATH)
    assert np.frombuffer(e.encode(["The cat, the Cat."])[0], "<u4").tolist() == plain("The cat, the Cat.")
    assert not e.known


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {x: i for i, x in enumerate(bins) if x + items[k] <= capacity}.values():
            bins[b] += items[k]
            go(k + 1, bins)
            bins[b] -= items[k]
        bins.append(items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def laid_out(items, capacity):
    counts, used, bins = Counter(items), Counter(), defaultdict(list)
    for w, first, upto, each, sequence, at in plan(dict(counts), capacity):
        assert first == used[w]
        used[w] = upto
        for r in range(upto - first):
            bins[sequence + r // each].append((at + r % each * w, w))
    assert used == counts
    for places in bins.values():
        at = 0
        for offset, w in sorted(places):
            assert offset == at
            at += w
        assert at <= capacity
    return len(bins)


def test_reduction_keeps_an_optimum():
    rnd = random.Random(5)
    close = 0
    for _ in range(500):
        capacity = rnd.choice([10, 13, 20, 30])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 10))]
        optimum = fewest(items, capacity)
        fixed, left = reduce_by_dominance(dict(Counter(items)), capacity)
        rest = list(itertools.chain.from_iterable([w] * n for w, n in left.items()))
        assert sum(t for _, t in fixed) + (fewest(rest, capacity) if rest else 0) == optimum
        close += laid_out(items, capacity) == optimum
    assert close >= 495


def test_large_counts_take_no_longer():
    counts = {w: 10**9 + w for w in range(1, 4097)}
    rows = plan(counts, 4096)
    assert len(rows) < 40_000
    assert sum(t for _, t in best_fit({3: 10**12}, 10)) == -(-(10**12) // 3)


def test_documents(spark, plain, monkeypatch):
    rows = awkward() + [(900, "word " * 300), (901, "word " * 63), (902, "word " * 64)]
    capacity = 64
    found = pack_documents(frame(spark, rows), PATH, capacity, with_ids=True).collect()
    want = []
    for d, t in rows:
        ids = [*plain(t), 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((d, k, at, len(own) // 4, zlib.crc32(own), own))
    assert order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in found) == order(want)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.03 * sum(w[3] for w in want) / capacity


def test_empty_table(spark):
    assert pack_documents(frame(spark, []), PATH).count() == 0


def test_a_worker_keeps_one_encoder_until_it_is_released():
    first = encoder(PATH)
    assert encoder(PATH) is first
    left = weakref.ref(first)
    del first
    tasks.release()
    assert left() is None
    again = weakref.ref(encoder(PATH))
    assert tasks.kept("other", list) == [] and again() is None
    tasks.release()
