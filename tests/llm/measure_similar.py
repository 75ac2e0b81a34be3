"""Recall of the near stage's links by kind of edit: python tests/llm/measure_similar.py [documents]."""

import os
import random
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


def edits(rnd, words):
    """Copies by kind, the larger ones near the threshold of 0.8."""
    n = len(words)
    new = lambda k: [f"new{rnd.randint(0, 10**9)}" for _ in range(k)]
    at = rnd.randint(0, n)
    scattered = list(words)
    for k in rnd.sample(range(n), max(1, n // 50)):
        scattered[k] = new(1)[0]
    return {
        "scattered": scattered,
        "block 5 %": words[:at] + new(n // 20) + words[at:],
        "block 10 %": words[:at] + new(n // 10) + words[at:],
        "prefix 15 %": new(n * 15 // 100) + words,
        "first 10 % cut": words[n // 10 :],
        "first 18 % cut": words[n * 18 // 100 :],
    }


def planted(texts, rnd):
    """``(rows, pairs)``: pairs (kind, id, copy) whose similarity reaches 0.8."""
    from tests.llm.test_simhash import shingles, similar

    rows, pairs = [], []
    for k, text in enumerate(texts):
        words = text.split()
        if len(words) < 40:
            continue
        rows.append((10 * k, text))
        for c, (kind, copy) in enumerate(edits(rnd, words).items(), 1):
            copy = " ".join(copy)
            if similar(shingles(text), shingles(copy)) and rnd.random() < 0.34:  # else copies help one another
                rows.append((10 * k + c, copy))
                pairs.append((kind, 10 * k, 10 * k + c))
    return rows, pairs


def recall(spark, texts, seed=1):
    from gleaner.llm.simhash import similar_links
    from tests.llm.texts import components, frame

    rows, pairs = planted(texts, random.Random(seed))
    found = components([d for d, _ in rows], [(r["a"], r["b"]) for r in similar_links(frame(spark, rows)).collect()])
    out = {}
    for kind, a, b in pairs:
        out.setdefault(kind, []).append(found[a] == found[b])
    return {kind: (sum(x) / len(x), len(x)) for kind, x in out.items()}


if __name__ == "__main__":
    from gleaner.session import local_session

    spark = local_session("measure")
    spark.sparkContext.setLogLevel("ERROR")
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 2000
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < " + str(n)).select("text").distinct().collect()]
    for kind, (share, count) in recall(spark, texts).items():
        print(f"{kind}: {share:.3f} of {count}")
