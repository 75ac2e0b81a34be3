import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm.packing import WordEncoder, pack_documents
from tests.llm.texts import frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_special_tokens_in_texts(spark):
    """An encoder left at its defaults gives special tokens their own ids, wherever they stand."""
    plain = Tokenizer.from_file(PATH)
    want = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert want("a <|endoftext|> b")[1] == 49407
    rnd = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "Cat", "É", "é", "cat.", ".", " ", "\n", " ", " ", "'s", "7", "<"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    e = WordEncoder(PATH)
    found = [x for at in range(0, len(texts), 100) for x in e.encode(texts[at : at + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [want(t) for t in texts]
    row = pack_documents(frame(spark, [(1, "one <|endoftext|> two<|startoftext|>")]), PATH).first()
    assert row["length"] == len(want("one <|endoftext|> two<|startoftext|>")) + 1 == 5
