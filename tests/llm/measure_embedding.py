"""Recall, and how work grows, of the embedding index: python tests/llm/measure_embedding.py [rows ...].

One label of made-up vectors in 64 dimensions, half of them near copies (cosine 0.90 to 0.999) of
others, is held against brute force. Prints, for each size: pivots, recall of links, rows of the
inverted lists, rows that were fetched, rows dealt to pairs of blocks.
"""

import sys
import time
from pathlib import Path

import numpy as np

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


def vectors(n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(n // 2, 64)))
    of = x[rng.integers(0, len(x), n - len(x))]
    z = rng.normal(size=of.shape)
    z = unit(z - (z * of).sum(axis=1, keepdims=True) * of)
    c = rng.uniform(0.90, 0.999, len(of))[:, None]
    return np.concatenate((x, c * of + np.sqrt(1 - c * c) * z)).astype(np.float32)


def links(x: np.ndarray) -> int:
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return sum(int((x[at : at + 1000] @ x.T >= 0.93).sum()) for at in range(0, len(x), 1000)) - len(x)


def main() -> None:
    import os

    os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
    from pyspark.sql import functions as F

    from gleaner.llm import embedding
    from gleaner.session import local_session

    spark = local_session("measure", 8)
    spark.sparkContext.setLogLevel("ERROR")
    plain, rows = embedding.materialise, {}

    def counted(df, tag):
        out = plain(df, tag)
        if tag in ("posted", "candidates"):
            rows[tag] = out.count()
        if tag == "lists":
            rows["most blocks"] = out.agg(F.max("blocks")).first()[0]
        return out

    embedding.materialise = counted
    for n in [int(a) for a in sys.argv[1:]] or [5_000, 20_000, 80_000]:
        x = vectors(n)
        df = spark.createDataFrame(((k, v.tolist(), 0) for k, v in enumerate(x)), "vec_id long, embedding array<float>, label int")
        began = time.perf_counter()
        found = embedding.link_vectors(df).agg(F.sum("n_links")).first()[0]
        took, every = time.perf_counter() - began, links(x)
        print(f"{n} rows, {embedding.pivots_for(n)} pivots: recall {found / every:.4f} of {every // 2} links, {rows}, {took:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
