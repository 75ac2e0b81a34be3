"""Hybrid search of a batch of queries: cosine and BM25, expansion, fusion, reranking, excerpts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.errors import Code, EngineError
from gleaner.operators.excerpt import excerpts
from gleaner.operators.fusion import fuse, protect, rerank_cutoff
from gleaner.operators.lexical import bm25_top, query_terms
from gleaner.operators.similarity import cosine_top
from gleaner.plans.index import Index
from gleaner.plans.models import Live, Models
from gleaner.session import materialise
from gleaner.sources.limits import check_request, format_query
from gleaner.sources.providers import Embedding, Expansion, Rerank, check_expansion, check_scores, check_vectors

DEPTH = 40
#: Fixed value: how long a search waits for its models.
SECONDS = 30.0

VARIANTS = "query_id long, place int, channel string, kind string, is_original boolean, text string, request string, left double, error string"


def _mapped(rows: DataFrame, function: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """What ``function`` gives for each row."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in function(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, schema)


def _guarded(function: Callable[[dict], list[tuple]], failed: Callable[[dict, str], tuple]) -> Callable[[dict], list[tuple]]:
    """``function``, with a row that names the code where it or the row itself has failed."""

    def run(row: dict) -> list[tuple]:
        try:
            return [failed(row, row["error"])] if row.get("error") else function(row)
        except EngineError as error:
            return [failed(row, error.code.value)]

    return run


class Failures:
    """The first code of each query that failed. Without ``kept`` one failure fails the batch."""

    def __init__(self, kept: bool):
        self.kept, self.rows = kept, None

    def without(self, rows: DataFrame) -> DataFrame:
        """``rows`` of queries of which none has an ``error``."""
        own = materialise(rows.where("error is not null").groupBy("query_id").agg(F.min("error").alias("code")), "failures")
        first = own.limit(1).collect()
        if first and not self.kept:
            raise EngineError(Code(first[0]["code"]), f"query {first[0]['query_id']} failed; there is no search without its stages")
        if not first:
            return rows.drop("error")
        self.rows = own if self.rows is None else self.rows.unionByName(own)
        return rows.join(own.select("query_id"), "query_id", "left_anti").drop("error")


def expand_queries(queries: DataFrame, models: Models, failures: Failures, instruction: str = "", seconds: float = SECONDS) -> DataFrame:
    """``query_id, place, channel, kind, is_original, text, left, v``: each query and its checked variants.

    Queries and variants go to the embedding with ``instruction``, made-up passages without it. A query
    over its budget and a variant that fails its check are failures.
    """

    def first(row: dict) -> list[tuple]:
        format_query(row["query"])
        return [(row["query_id"], 0, row["query"], seconds * 1000, None)]

    def variants(row: dict) -> list[tuple]:
        query, key = row["request"], row["query_id"]
        found = check_expansion(query, json.loads(row["answer"]))
        rows = [("bm25", "lex", True, query), ("cosine", "vec", True, query)]
        rows += [(f"{kind}{k}", "lex" if kind == "lex" else "vec", False, text) for kind, texts in found.items() for k, text in enumerate(texts)]
        asked = lambda c, kind, text: None if kind == "lex" else text if c.startswith("hyde") else format_query(text, instruction=instruction)
        return [(key, place, c, kind, own, text, asked(c, kind, text), row["left"], None) for place, (c, kind, own, text) in enumerate(rows)]

    def vector(row: dict) -> list[tuple]:
        return [(row["query_id"], row["place"], row["left"], check_vectors([row["request"]], [json.loads(row["answer"])], size)[0], None)]

    size = models.size
    begun = _mapped(queries.select("query_id", "query"), _guarded(first, lambda r, e: (r["query_id"], 0, r["query"], 0.0, e)), "query_id long, place int, request string, left double, error string")
    begun = failures.without(materialise(begun, "begun"))
    lost = lambda r, e: (r["query_id"], 0, None, None, None, None, None, r["left"], e)
    out = failures.without(materialise(_mapped(models.ask("expand", begun), _guarded(variants, lost), VARIANTS), "variants"))
    answered = models.ask("embed", out.where("kind = 'vec'"))
    lost = lambda r, e: (r["query_id"], r["place"], r["left"], None, e)
    found = failures.without(materialise(_mapped(answered, _guarded(vector, lost), "query_id long, place int, left double, v array<float>, error string"), "vectors"))
    left = found.groupBy("query_id").agg(F.min("left").alias("left"))
    return out.drop("left", "request").join(found.drop("left"), ["query_id", "place"], "left").join(left, "query_id")


def search(
    spark: SparkSession, index: Index, queries: DataFrame, embedding: Embedding | Models, expansion: Expansion | None = None, reranking: Rerank | None = None, best: int = 8, instruction: str = "", seconds: float = SECONDS, failures: Failures | None = None
) -> DataFrame:
    """``query_id, rank, score, source, passage_id, start, end, snippet`` for ``queries`` (query_id long, query).

    The models are three providers, or :class:`Models` in their place. ``seconds`` is the time that
    a query may spend on all of them together. A request over a budget, an answer that fails its check
    and a query that runs out of time fail the batch, or with ``Failures(True)`` the query.
    """
    models = embedding if expansion is None else Live(embedding, expansion, reranking)
    failures = failures or Failures(False)
    variants = materialise(expand_queries(queries, models, failures, instruction, seconds).withColumn("variant", F.monotonically_increasing_id()), "variants")
    passages, posted = index.numbered(), index.by_number()
    names = F.broadcast(variants.select(F.col("variant").alias("query_id"), F.col("query_id").alias("q"), "channel", "is_original"))
    terms = query_terms(variants.where("kind = 'lex'"), "variant", "text")
    lexical = bm25_top(posted, terms, DEPTH)
    near = cosine_top(variants.where("kind = 'vec'").select(F.col("variant").alias("id"), "v"), index.packed(), DEPTH)
    lists = lexical.unionByName(near).join(names, "query_id").select(F.col("q").alias("query_id"), "channel", "is_original", "id", "rank")
    lists = materialise(lists, "lists")  # some rows a query, joined to passages as what they are
    fused = materialise(protect(fuse(lists).join(passages.select("id", "source"), "id")), "fused")
    asked = queries.select("query_id", "query").join(variants.groupBy("query_id").agg(F.min("left").alias("left")), "query_id")
    texts = materialise(fused.join(passages.drop("source"), "id").join(asked, "query_id"), "texts")

    def request(row: dict) -> list[tuple]:
        documents = [x["text"] for x in row["found"]]
        check_request(row["query"], documents)
        return [(row["query_id"], 0, json.dumps({"query": row["query"], "documents": documents}, ensure_ascii=False), row["left"], None)]

    def scores(row: dict) -> list[tuple]:
        found = check_scores(json.loads(row["request"])["documents"], json.loads(row["answer"]))
        return [(row["query_id"], k, s, None) for k, s in enumerate(found, 1)]

    # a query has ``DEPTH`` passages at most
    grouped = texts.groupBy("query_id", "query", "left").agg(F.array_sort(F.collect_list(F.struct("fused_rank", "text"))).alias("found"))
    requests = _mapped(grouped, _guarded(request, lambda r, e: (r["query_id"], 0, "", 0.0, e)), "query_id long, place int, request string, left double, error string")
    answered = models.ask("rerank", failures.without(materialise(requests, "requests")))
    relevant = _mapped(answered, _guarded(scores, lambda r, e: (r["query_id"], 0, None, e)), "query_id long, index int, relevance double, error string")
    relevant = failures.without(materialise(relevant, "relevant"))
    models.finish()
    scored = relevant.join(texts.select("query_id", "id", F.col("fused_rank").alias("index")), ["query_id", "index"])
    ranked = rerank_cutoff(scored.select("query_id", "id", F.col("index").cast("long").alias("index"), "relevance"), best=best)
    own = query_terms(queries, "query_id", "query")
    weights = own.join(index.rarity(), "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    shown = ranked.join(texts.select("query_id", "id", "passage_id", "source", "text", F.col("start").alias("at")), ["query_id", "id"]).join(weights, "query_id", "left")
    cut = excerpts(shown.select("query_id", "rank", "score", "source", "passage_id", "at", "text", F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights")))
    return cut.select("query_id", "rank", "score", "source", "passage_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "snippet")


@dataclass
class Observation:
    """A search with what became of each query, and every attempt of every model.

    ``outcomes``: query_id, status (PASS or FAIL), code, known_cost, unknown_costs, elapsed_ms;
    ``attempts``: query_id, kind, place, attempt, outcome, elapsed_ms, cost; ``record`` can be replayed.
    """

    results: DataFrame
    outcomes: DataFrame
    attempts: DataFrame
    record: DataFrame


def observe(spark: SparkSession, index: Index, queries: DataFrame, models: Live, **options) -> Observation:
    """Search, and keep failures apart by query instead of failing. Costs that nobody knows are counted, not taken as nothing."""
    failures = Failures(True)
    results = materialise(search(spark, index, queries, models, failures=failures, **options), "results")
    attempts = models.attempts()
    spent = attempts.groupBy("query_id").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("known_cost"), F.count_if(F.col("cost").isNull()).alias("unknown_costs"), F.sum("elapsed_ms").alias("elapsed_ms"))
    failed = failures.rows if failures.rows is not None else spark.createDataFrame([], "query_id long, code string")
    outcomes = queries.select("query_id").join(failed, "query_id", "left").join(spent, "query_id", "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    outcomes = outcomes.select("query_id", F.when(F.col("code").isNull(), "PASS").otherwise("FAIL").alias("status"), "code", zero("known_cost", 0.0), zero("unknown_costs", 0), zero("elapsed_ms", 0.0))
    return Observation(results, outcomes, attempts, models.record())
