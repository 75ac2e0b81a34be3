"""The search from end to end, held against a plain form of it over the same passages."""

import math
from collections import Counter, defaultdict

import numpy as np
import regex

from gleaner.functions.text import TOKEN
from gleaner.operators.lexical import WEIGHTS
from gleaner.plans import index, queries
from gleaner.plans.search import search
from gleaner.sources import providers
from tests.windows import best_window, occurrences


def terms(text):
    return [t for m in regex.finditer(TOKEN, text) for t in dict.fromkeys(t for t, _, _ in occurrences(m.group()))]


class Plain:
    """BM25 over three fields and cosine, over passages as rows."""

    def __init__(self, rows, vectors):
        self.rows = {r["passage_id"]: r for r in rows}
        self.vectors = {r["passage_id"]: np.array(vectors[r["chunk_hash"]], np.float64) for r in rows}
        self.fields = {}
        for field, own in (("body", lambda r: r["text"]), ("headings", lambda r: " ".join(r["headings"])), ("path", lambda r: r["source"])):
            counts = {k: Counter(terms(own(r))) for k, r in self.rows.items()}
            sizes = {k: sum(c.values()) for k, c in counts.items()}
            self.fields[field] = (counts, sizes, sum(sizes.values()), Counter(t for c in counts.values() for t in c))

    def idf(self, term, field="body"):
        df = self.fields[field][3][term]
        return math.log(1 + (len(self.rows) - df + 0.5) / (df + 0.5))

    def lexical(self, query):
        scores = defaultdict(float)
        for field, (counts, sizes, total, frequency) in self.fields.items():
            for t in set(terms(query)) & set(frequency):
                for k, c in counts.items():
                    if c[t]:
                        scores[k] += WEIGHTS[field] * self.idf(t, field) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sizes[k] * len(self.rows) / total))
        return self.best({k: round(s, 6) for k, s in scores.items()})

    def cosine(self, v):
        v = np.array(v, np.float32).astype(np.float64)
        return self.best({k: round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6) for k, w in self.vectors.items()})

    def best(self, scores):
        return [k for k, _ in sorted(scores.items(), key=lambda x: (-x[1], self.place(x[0])))[:40]]

    def place(self, k):
        return self.rows[k]["source"], self.rows[k]["start"], self.rows[k]["end"], k

    def search(self, query, model, expansion, reranking):
        found = expansion.expand(query)
        lists = [(2.0, self.lexical(query)), (2.0, self.cosine(model.embed([query])[0]))]
        lists += [(1.0, self.lexical(t)) for t in found["lex"]] + [(1.0, self.cosine(model.embed([t])[0])) for t in found["vec"] + found["hyde"]]
        score, kept = defaultdict(float), set()
        for weight, ids in lists:
            for rank, k in enumerate(ids, 1):
                score[k] += weight / (60 + rank)
                if weight == 2.0 and rank <= 8:
                    kept.add(k)
        order = sorted(score, key=lambda k: (-round(score[k], 9), self.place(k)))
        protected = Counter(self.rows[k]["source"] for k in kept)
        others, classes = Counter(), {}
        for k in order:
            source = self.rows[k]["source"]
            others[source] += k not in kept
            classes[k] = 0 if k in kept else 1 if protected[source] + others[source] <= 2 else 2
        chosen = sorted(sorted(order, key=lambda k: (classes[k], order.index(k)))[:40], key=order.index)
        relevance = reranking.rerank(query, [self.rows[k]["text"] for k in chosen])
        ranked = sorted((k for k in range(len(chosen)) if relevance[k] >= 0.435546875), key=lambda k: (-relevance[k], k))[:8]
        weights = {t: self.idf(t) for t in set(terms(query)) if self.fields["body"][3][t]}
        out = []
        for rank, k in enumerate(ranked, 1):
            r = self.rows[chosen[k]]
            a, b = best_window(r["text"], weights)
            out.append((rank, round(1 / rank, 6), chosen[k], r["start"] + a, r["start"] + b))
        return out


def test_search_gives_what_its_plain_form_gives(spark, data, tmp_path):
    model, expansion, reranking = providers.HashEmbedding(64), providers.SwappedExpansion(), providers.OverlapRerank()
    root = str(tmp_path / "index")
    index.prepare(spark, queries._sources(spark, data), root, model)
    opened = index.Index(spark, root, model)
    asked = queries.questions(spark, data).withColumnRenamed("item_id", "query_id")
    found = defaultdict(list)
    for r in search(spark, opened, asked, model, expansion, reranking).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["score"], r["passage_id"], r["start"], r["end"]))
    plain = Plain(opened.passages().collect(), {r["chunk_hash"]: r["embedding"] for r in opened.vectors().collect()})
    texts = {r["query_id"]: r["query"] for r in asked.collect()}
    assert any(expansion.expand(q)["lex"] for q in texts.values()) and sum(map(len, found.values())) > 10
    for key, query in texts.items():
        assert found[key] == plain.search(query, model, expansion, reranking), (key, query)


def test_scores_of_an_index_are_summed_where_its_postings_are_read(spark, tmp_path):
    from gleaner.operators.lexical import bm25, query_terms
    from gleaner.plans.index import Index, prepare
    from gleaner.sources.providers import HashEmbedding

    model, root = HashEmbedding(8), str(tmp_path / "index")
    rows = [(f".agent/knowledge/{k}.md", f"alpha word{k % 3} beta") for k in range(12)]
    prepare(spark, spark.createDataFrame(rows, "source string, text string"), root, model)
    opened = Index(spark, root, model)
    terms = query_terms(spark.createDataFrame([(1, "alpha word1")], "query_id long, text string"), "query_id", "text")
    scored = bm25(opened.by_number(), terms)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    named = scored.join(opened.numbered().select("id", "passage_id"), "id").select("query_id", "passage_id", "score")
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, bm25(opened.lexical(), terms).collect()))
