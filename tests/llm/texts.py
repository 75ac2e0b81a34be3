"""Small tables with the awkward cases, and plain versions of what operators compute."""

import random

#: Columns beside those that operators read; some names are used inside operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, digest string, part string, slot int"


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """Ids and texts: nulls, empty and long texts, copies, shared passages, repeated rows."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Ärger", "naïve", "日本", "x y"]
    passage = " ".join(f"shared{k}" for k in range(40))
    texts: list = [None, "", "   \t\n", "one", "one two", "ONE two", " ", "a" * 5000, "b " * 3000, passage, passage.upper()]
    for _ in range(n):
        own = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))
        texts.append(rnd.choice([own, own + "\n" + passage, passage + "\r\n" + own, own, rnd.choice(texts)]))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    rows += [rows[3], rows[7], (rows[5][0], "another text under the same id"), (None, passage + " and no id"), (None, None), (-5, passage), (2**62, passage + " tail")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", None, "r", True, "d", "p", 1) for d, t in rows], SCHEMA)


def split(text):
    return (text or "").encode().split()


LAST = 2**63 - 1


def cut_brute(rows, window):
    """(id, words, removed, kept text) of each row."""
    key = lambda d: LAST if d is None else d
    first = {}
    for d, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, LAST), key(d))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(d):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def components(nodes, links):
    """Smallest node that each reaches."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def order(rows):
    return sorted(rows, key=repr)
