"""The queries of the library over the shared tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import baseline, compare, contract, excerpt, fusion, lexical, metrics, patterns, sections, similarity, spans
from gleaner.plans import index, models, search
from gleaner.session import materialise, shared_path, ship
from gleaner.sources import markdown, providers

#: The literal query of the single-query searches, and its variant.
QUERY, VARIANT = "the heat of this erth and ontion", "thatst ered tion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "source", T.knowledge_path(F.col("source"), F.col("doc_id")).alias("path"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short questions: the first five words of each benchmark item."""
    words = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 5))
    return table(spark, sf_dir, "benchmark").select("item_id", words.alias("query"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: the whole text of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))


# Lexical

TOKEN_SQL = r"""regexp_extract_all({0}, '[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_./:@-]*[\p{{L}}\p{{N}}])?')"""
HUMP_SQL = r"""regexp_replace(regexp_replace(p, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')"""
TERMS_SQL = (
    "list_distinct(list_concat([lower({0})], flatten(list_transform(regexp_split_to_array({0}, '[_./:@-]+'), "
    "lambda p: list_concat([lower(p)], list_transform(string_split(" + HUMP_SQL.replace("{", "{{").replace("}", "}}") + ", ' '), lambda c: lower(c)))))))"
)


def _terms_sql(name: str, source: str, key: str, column: str, where: str = "TRUE") -> str:
    """Two common table expressions: ``<name>`` (key, term), a row for each occurrence."""
    return (
        f"{name}_m AS (SELECT {key}, unnest({TOKEN_SQL.format(column)}) AS m FROM {source} WHERE {where}), "
        f"{name}_d AS (SELECT DISTINCT m FROM {name}_m), {name}_e AS (SELECT m, unnest({TERMS_SQL.format('m')}) AS term FROM {name}_d), "
        f"{name} AS (SELECT {key}, term FROM {name}_m JOIN {name}_e USING (m))"
    )


def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.postings(passages(spark, sf_dir), "doc_id", "text")
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


TOKEN_FREQUENCIES = f"WITH {_terms_sql('t', 'documents', 'doc_id', 'text')} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term"


def path_field_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.postings(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url")
    return found.groupBy("term").agg(F.count("*").alias("df"))


PATH_FIELD_TERMS = f"WITH {_terms_sql('t', 'pages', 'page_id', 'url')} SELECT term, count(DISTINCT page_id) AS df FROM t GROUP BY term"


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build_index(passages(spark, sf_dir), "doc_id", {"body": "text", "path": "path"}).saved()


def lexical_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("field", "total_length", "n")


_CORPUS = "corpus AS (SELECT doc_id, text, source, concat('.agent/knowledge/', source, '/', doc_id, '.md') AS path FROM documents)"
_FIELDS = (
    f"{_CORPUS}, {_terms_sql('tb', 'corpus', 'doc_id', 'text')}, {_terms_sql('tp', 'corpus', 'doc_id', 'path')}, "
    "postings AS (SELECT 'body' AS field, doc_id, term, count(*) AS tf FROM tb GROUP BY ALL UNION ALL SELECT 'path', doc_id, term, count(*) FROM tp GROUP BY ALL), "
    "lengths AS (SELECT f.field, d.doc_id, coalesce(sum(tf), 0)::BIGINT AS len FROM corpus d CROSS JOIN (VALUES ('body'), ('path')) f(field) LEFT JOIN postings p ON p.field = f.field AND p.doc_id = d.doc_id GROUP BY ALL), "
    "stats AS (SELECT field, sum(len)::BIGINT AS total_length, count(*) AS n FROM lengths GROUP BY field)"
)
LEXICAL_LENGTHS = f"WITH {_FIELDS} SELECT field, total_length, n FROM stats"

_BM25 = (
    "freq AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL), "
    "scored AS (SELECT q.query_id, p.doc_id AS id, round(sum(ln(1e0 + (s.n - f.df + 5e-1) / (f.df + 5e-1)) * p.tf * 2.2e0 "
    "/ (p.tf + 1.2e0 * (25e-2 + 75e-2 * (l.len * s.n / (s.total_length * 1e0)))) * CASE p.field WHEN 'body' THEN 1e0 ELSE 2e0 END), 6) AS score "
    "FROM q JOIN postings p ON p.term = q.term JOIN freq f ON f.term = p.term AND f.field = p.field JOIN lengths l ON l.field = p.field AND l.doc_id = p.doc_id "
    "JOIN stats s ON s.field = p.field GROUP BY ALL), "
    "lex AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM scored QUALIFY rank <= 40)"
)


def literal_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("item_id"), F.lit(text).alias("query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    terms = lexical.query_terms(literal_query(spark, QUERY), "item_id", "query")
    return lexical.top(lexical.bm25(_index(spark, sf_dir), terms), 8).select("rank", F.col("id").alias("doc_id"), "score")


_LITERAL = f"lq AS (SELECT 0 AS query_id, '{QUERY}' AS query), {_terms_sql('lt', 'lq', 'query_id', 'query')}, q AS (SELECT DISTINCT query_id, term FROM lt)"
BM25_TOPK = f"WITH {_FIELDS}, {_LITERAL}, {_BM25} SELECT rank, id AS doc_id, score FROM lex WHERE rank <= 8"

_WHOLE_ITEMS = f"iq AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_terms_sql('it', 'iq', 'query_id', 'query')}, q AS (SELECT DISTINCT query_id, term FROM it)"


def _lexical_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.query_terms(questions(spark, sf_dir), "item_id", "query")
    return lexical.top(lexical.bm25(_index(spark, sf_dir), terms), 40)


def bm25_fielded_batch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of every question."""
    return _lexical_lists(spark, sf_dir).where("rank <= 10").select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


BM25_FIELDED_BATCH_WHOLE = f"WITH {_FIELDS}, {_WHOLE_ITEMS}, {_BM25} SELECT query_id AS item_id, rank, id AS doc_id, score FROM lex WHERE rank <= 10"


# Vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings")
    return found.where(V.valid(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    query = F.broadcast(rows.where("id = 0").limit(1).select(F.col("v").alias("q")))
    scored = rows.join(query).select("id", F.round(V.cosine(F.col("v"), F.col("q")), 6).alias("score"))
    ordered = scored.withColumn("query_id", F.lit(0))
    return lexical.top(ordered, 8).select("rank", F.col("id").alias("vec_id"), "score")


_COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
COSINE_TOPK = f"SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM (SELECT b.vec_id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) QUALIFY rank <= 8"


def cosine_batch_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(_vectors(spark, sf_dir), "vectors")
    found = similarity.cosine_top(rows.where("id % 20 = 0"), rows, 40)
    return found.select(F.col("query_id").alias("qid"), "rank", F.col("id").alias("vec_id"), "score")


COSINE_BATCH_TOP40 = f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM (SELECT a.vec_id AS qid, b.vec_id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) QUALIFY rank <= 40"


def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return found.select("vec_id", F.size(v).cast("long").alias("dim"), F.round(V.norm(v), 6).alias("norm"), V.valid(v, 64).alias("valid"))


VECTOR_VALIDATION = "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings"


# Fusion


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector lists of the items; an item's vector is the embedding of its number."""
    rows = materialise(_vectors(spark, sf_dir).join(passages(spark, sf_dir).select(F.col("doc_id").alias("id")), "id", "left_semi"), "vectors")
    queries = rows.join(items(spark, sf_dir).select(F.col("item_id").alias("id")), "id", "left_semi")
    return similarity.cosine_top(queries, rows, 40).select("query_id", F.lit("cosine").alias("channel"), F.lit(True).alias("is_original"), "id", "rank")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector lists of the questions."""
    found = _lexical_lists(spark, sf_dir).select("query_id", F.lit("bm25").alias("channel"), F.lit(True).alias("is_original"), "id", "rank")
    return _near(spark, sf_dir).unionByName(found)


_NEAR = (
    f"near AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS score "
    "FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 40)"
)
_LISTS = f"{_FIELDS}, {_WHOLE_ITEMS}, {_BM25}, {_NEAR}, lists AS (SELECT query_id, TRUE AS original, id, rank FROM lex UNION ALL SELECT query_id, TRUE, id, rank FROM near)"
_FUSED = "fused AS (SELECT query_id, id, round(sum(CASE WHEN original THEN 2e0 ELSE 1e0 END / (60 + rank)), 9) AS score, bool_or(original AND rank <= 8) AS prot FROM lists GROUP BY ALL)"


def rrf_fusion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(_lists(spark, sf_dir))
    return lexical.top(fused.select("query_id", "id", "score"), 40).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


RRF_FUSION_WHOLE = f"WITH {_LISTS}, {_FUSED} SELECT query_id AS item_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 40"


def protected_fusion_40_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    out = fusion.protect(fusion.fuse(_lists(spark, sf_dir)).join(sources, "id"))
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "class", "fused_rank")


_PROTECTED = """
o AS (SELECT f.*, d.source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.source, id) AS fo FROM fused f JOIN documents d ON d.doc_id = f.id),
p AS (SELECT *, sum(prot::INT) OVER (PARTITION BY query_id, source) AS pc, row_number() OVER (PARTITION BY query_id, source, prot ORDER BY fo) AS rn FROM o),
c AS (SELECT *, CASE WHEN prot THEN 0 WHEN pc + rn <= 2 THEN 1 ELSE 2 END AS class FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class, fo) AS place FROM c QUALIFY place <= 40)
"""
PROTECTED_FUSION_40_WHOLE = f"WITH {_LISTS}, {_FUSED}, {_PROTECTED} SELECT query_id AS item_id, id AS doc_id, class, row_number() OVER (PARTITION BY query_id ORDER BY fo) AS fused_rank FROM k"


def expanded_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One literal query and one lexical variant of it, fused."""
    queries = literal_query(spark, QUERY).unionByName(spark.range(1).select(F.lit(1).cast("long").alias("item_id"), F.lit(VARIANT).alias("query")))
    found = lexical.top(lexical.bm25(_index(spark, sf_dir), lexical.query_terms(queries, "item_id", "query")), 40)
    lists = found.select(F.lit(0).alias("query_id"), F.col("query_id").cast("string").alias("channel"), (F.col("query_id") == 0).alias("is_original"), "id", "rank")
    return fusion.fuse(lists).select(F.col("id").alias("doc_id"), "score")


EXPANDED_FUSION = (
    f"WITH {_FIELDS}, lq AS (SELECT 0 AS query_id, '{QUERY}' AS query UNION ALL SELECT 1, '{VARIANT}'), {_terms_sql('lt', 'lq', 'query_id', 'query')}, q AS (SELECT DISTINCT query_id, term FROM lt), {_BM25}, "
    f"lists AS (SELECT 0 AS query_id, query_id = 0 AS original, id, rank FROM lex), {_FUSED} SELECT id AS doc_id, score FROM fused"
)


def _both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical lists of every question, and of its short form as a variant."""
    ways = questions(spark, sf_dir).withColumn("item_id", F.col("item_id") * 2).unionByName(items(spark, sf_dir).withColumn("item_id", F.col("item_id") * 2 + 1))
    found = lexical.top(lexical.bm25(_index(spark, sf_dir), lexical.query_terms(ways, "item_id", "query")), 40)
    way = F.pmod("query_id", F.lit(2))
    return found.select(F.floor(F.col("query_id") / 2).alias("query_id"), way.cast("string").alias("channel"), (way == 0).alias("is_original"), "id", "rank")


def expanded_fusion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and its short form as a lexical variant, fused."""
    return fusion.fuse(_both_ways(spark, sf_dir)).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score")


EXPANDED_FUSION_BATCH = (
    f"WITH {_FIELDS}, lq AS (SELECT item_id * 2 AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:5], ' ') FROM benchmark), {_terms_sql('lt', 'lq', 'query_id', 'query')}, "
    f"q AS (SELECT DISTINCT query_id, term FROM lt), {_BM25}, lists AS (SELECT query_id // 2 AS query_id, query_id % 2 = 0 AS original, id, rank FROM lex), {_FUSED} SELECT query_id AS item_id, id AS doc_id, score FROM fused"
)


def ablation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five views of the same lists: what each part of a search adds to the result."""
    lists, channel = _both_ways(spark, sf_dir).unionByName(_near(spark, sf_dir)), F.col("channel")
    views = {"lexical": channel == "0", "vector": channel == "cosine", "original": F.col("is_original"), "lexical expanded": channel != "cosine", "expanded": F.lit(True)}
    return fusion.fuse_views(lists, views).select("view", F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score", "protected")


ABLATION_VIEWS = f"""
WITH {_FIELDS}, lq AS (SELECT item_id * 2 AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[1:5], ' ') FROM benchmark), {_terms_sql('lt', 'lq', 'query_id', 'query')},
q AS (SELECT DISTINCT query_id, term FROM lt), {_BM25}, {_NEAR},
lists AS (SELECT query_id // 2 AS query_id, (query_id % 2)::VARCHAR AS channel, query_id % 2 = 0 AS original, id, rank FROM lex UNION ALL SELECT query_id, 'cosine', TRUE, id, rank FROM near),
viewed AS (SELECT view, lists.* FROM lists JOIN (VALUES ('lexical', '0'), ('vector', 'cosine'), ('original', '0'), ('original', 'cosine'), ('lexical expanded', '0'), ('lexical expanded', '1'), ('expanded', '0'), ('expanded', '1'), ('expanded', 'cosine')) v(view, c) ON c = channel),
fused AS (SELECT view, query_id, id, round(sum(CASE WHEN original THEN 2e0 ELSE 1e0 END / (60 + rank)), 9) AS score, bool_or(original AND rank <= 8) AS protected FROM viewed GROUP BY ALL)
SELECT view, query_id AS item_id, row_number() OVER (PARTITION BY view, query_id ORDER BY score DESC, id) AS rank, id AS doc_id, score, protected FROM fused QUALIFY rank <= 40
"""


def adapted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    query = F.broadcast(rows.where("id = 0").limit(1).select(F.col("v").alias("q")))
    scored = rows.join(query).select(F.col("id").alias("doc_id"), V.cosine(F.col("v"), F.col("q")).alias("cosine"))
    found = passages(spark, sf_dir).join(scored, "doc_id").select(F.lit(0).alias("query_id"), F.lit(QUERY).alias("query"), F.col("doc_id").alias("id"), "source", F.lit("").alias("heading"), "text", "cosine")
    return baseline.rank_baseline(found).select("rank", F.col("id").alias("doc_id"), "score")


_BASE = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+(?:[./:@-][\p{{L}}\p{{N}}_]+)*'))"
ADAPTED_BASELINE = f"""
WITH w AS (SELECT d.doc_id, d.source, d.text, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine
  FROM embeddings a, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id = 0),
s AS (SELECT doc_id, source, round(8e-1 * cosine + 6e-2 * len(list_intersect({_BASE.format(f"'{QUERY}'")}, {_BASE.format("text")})) / len({_BASE.format(f"'{QUERY}'")})
  + 1e-2 * len(list_intersect({_BASE.format(f"'{QUERY}'")}, {_BASE.format("source")})) / len({_BASE.format(f"'{QUERY}'")})
  + CASE WHEN contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '{QUERY}') THEN 1e-1 ELSE 0e0 END, 6) AS score FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM s WHERE score >= 25e-2 QUALIFY n = 1)
SELECT row_number() OVER (ORDER BY score DESC, source, doc_id) AS rank, doc_id, score FROM o QUALIFY rank <= 8
"""


def adapted_baseline_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline for every question; its vector is the embedding of its number."""
    rows = _vectors(spark, sf_dir)
    asked = rows.withColumnRenamed("id", "query_id").join(questions(spark, sf_dir).withColumnRenamed("item_id", "query_id"), "query_id")
    docs = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", F.lit("").alias("heading"), "text")
    found = baseline.rank_baseline_batch(materialise(asked, "asked"), rows, docs)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ADAPTED_BASELINE_BATCH = rf"""
WITH dt AS MATERIALIZED (SELECT doc_id, source, {_BASE.format("text")} AS body, {_BASE.format("source")} AS path, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS flat FROM documents),
qt AS MATERIALIZED (SELECT item_id, {_BASE.format("text")} AS words, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS phrase FROM benchmark),
s AS (SELECT item_id, doc_id, source, round(8e-1 * list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
  + CASE WHEN len(words) = 0 THEN 0e0 ELSE 6e-2 * len(list_intersect(words, body)) / len(words) + 1e-2 * len(list_intersect(words, path)) / len(words) END
  + CASE WHEN length(phrase) > 0 AND contains(flat, phrase) THEN 1e-1 ELSE 0e0 END, 6) AS score
  FROM qt JOIN embeddings a ON a.vec_id = item_id CROSS JOIN embeddings b JOIN dt ON doc_id = b.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS n FROM s WHERE score >= 25e-2 QUALIFY n = 1)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source, doc_id) AS rank, doc_id, score FROM o QUALIFY rank <= 8
"""


def rerank_cutoff_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector lists reranked by a stand-in whose relevance is the cosine moved to 0..1."""
    rows = materialise(_vectors(spark, sf_dir), "vectors")
    found = similarity.cosine_top(rows.where("id % 20 = 0"), rows, 40)
    scored = found.select("query_id", "id", F.col("rank").alias("index"), F.round((F.col("score") + 1) / 2, 6).alias("relevance"))
    return fusion.rerank_cutoff(scored, best=8).select(F.col("query_id").alias("qid"), "rank", F.col("id").alias("vec_id"), "score")


RERANK_CUTOFF_TOP8 = f"""
WITH near AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS idx, vec_id, round((score + 1) / 2, 6) AS relevance
  FROM (SELECT a.vec_id AS qid, b.vec_id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) QUALIFY idx <= 40)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, idx) AS rank, vec_id, round(1e0 / row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, idx), 6) AS score
FROM near WHERE relevance >= 435546875e-9 QUALIFY rank <= 8
"""


# Texts, spans and identities


def snippet_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


SNIPPET_PREFIX = "SELECT doc_id, concat(substring(text, 1, 400), CASE WHEN length(text) > 400 THEN '…' ELSE '' END) AS snippet FROM documents"


def best_window_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of the eight best results of every question."""
    terms = materialise(lexical.query_terms(questions(spark, sf_dir), "item_id", "query"), "terms")
    posted = _index(spark, sf_dir)
    posted.postings = materialise(posted.postings.join(terms.select("term").distinct(), "term", "left_semi"), "postings")
    found = lexical.top(lexical.bm25(posted, terms), 8)
    total = passages(spark, sf_dir).count()
    body = posted.postings.where("field = 'body'").groupBy("term").agg(F.count("*").alias("df"))
    idf = body.select("term", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = terms.join(idf, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    rows = found.join(passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id").join(weights, "query_id", "left")
    out = excerpt.excerpts(rows.select("query_id", "rank", "id", "text", F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights")))
    return out.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "start", "end")


_PLACES = (
    "shown AS (SELECT query_id, rank, id, text FROM lex JOIN documents ON doc_id = id WHERE rank <= 8), "
    "rare AS (SELECT term, CAST(round(ln(1e0 + ((SELECT count(*) FROM documents) - df + 5e-1) / (df + 5e-1)) * 1e9) AS BIGINT) AS w FROM freq WHERE field = 'body'), "
    f"ta AS (SELECT query_id, rank, length(text) AS len, unnest({TOKEN_SQL.format('text')}) AS m, unnest({TOKEN_SQL.format('text').replace('regexp_extract_all', 'regexp_split_to_array')}) AS g, "
    f"generate_subscripts({TOKEN_SQL.format('text').replace('regexp_extract_all', 'regexp_split_to_array')}, 1) AS k FROM shown), "
    "tb2 AS (SELECT query_id, rank, len, k, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY query_id, rank ORDER BY k) - length(m) AS mat FROM ta), "
    "pa AS (SELECT *, unnest(regexp_split_to_array(m, '[_./:@-]+')) AS p, unnest(list_concat([''], regexp_extract_all(m, '[_./:@-]+'))) AS g, generate_subscripts(regexp_split_to_array(m, '[_./:@-]+'), 1) AS j FROM tb2 WHERE m IS NOT NULL), "
    "pb AS (SELECT *, count(*) OVER (PARTITION BY query_id, rank, k) AS np, mat + sum(length(g) + length(p)) OVER (PARTITION BY query_id, rank, k ORDER BY j) - length(p) AS pat FROM pa), "
    f"ha AS (SELECT *, unnest(string_split({HUMP_SQL}, ' ')) AS h, generate_subscripts(string_split({HUMP_SQL}, ' '), 1) AS i FROM pb), "
    "hb AS (SELECT *, count(*) OVER (PARTITION BY query_id, rank, k, j) AS nh, pat + sum(length(h)) OVER (PARTITION BY query_id, rank, k, j ORDER BY i) - length(h) AS hat FROM ha), "
    "occ AS (SELECT query_id, rank, len, lower(m) AS term, mat AS a, mat + length(m) AS b FROM hb WHERE i = 1 AND j = 1 UNION SELECT query_id, rank, len, lower(p), pat, pat + length(p) FROM hb WHERE i = 1 AND np > 1 "
    "UNION SELECT query_id, rank, len, lower(h), hat, hat + length(h) FROM hb WHERE nh > 1), "
    "hit AS (SELECT o.*, least(400, len) AS width, w FROM occ o JOIN q USING (query_id, term) JOIN rare USING (term) WHERE b - a <= least(400, len)), "
    "begins AS (SELECT DISTINCT query_id, rank, greatest(0, b - width) AS p FROM hit), "
    "held AS (SELECT DISTINCT query_id, rank, p, term, w FROM begins JOIN hit USING (query_id, rank) WHERE a >= p AND b <= p + width), "
    "worth AS (SELECT query_id, rank, p, sum(w) AS score FROM held GROUP BY ALL), "
    "best AS (SELECT query_id, rank, p FROM worth QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, p) = 1)"
)
BEST_WINDOW_EXCERPT = (
    f"WITH {_FIELDS}, {_WHOLE_ITEMS}, {_BM25}, {_PLACES} SELECT query_id AS item_id, rank, id AS doc_id, coalesce(p, 0)::BIGINT AS start, (coalesce(p, 0) + least(400, length(text)))::BIGINT AS \"end\" "
    "FROM shown LEFT JOIN best USING (query_id, rank)"
)


def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", T.source_hash(F.col("text")).alias("source_hash"))


SOURCE_HASHES = r"SELECT doc_id, concat('sha256:', sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))) AS source_hash FROM documents"


def passage_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return passages(spark, sf_dir).select("doc_id", T.passage_id(F.col("path"), F.lit(0), F.length(body), body).alias("passage_id"), T.safe_source(F.col("path")).alias("safe"))


PASSAGE_IDENTITY = f"WITH {_CORPUS} SELECT doc_id, concat('sha256:', sha256(concat('[\"', path, '\",0,', length(text), ',\"', sha256(text), '\"]'))) AS passage_id, TRUE AS safe FROM corpus"


def position_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the middle of every text, and its number of lines."""
    body, middle = F.col("text"), F.floor(F.length("text") / 2)
    return passages(spark, sf_dir).select("doc_id", F.size(F.split(body, "\n")).cast("long").alias("n_lines"), T.line_of(body, middle).alias("line"), T.column_of(body, middle).alias("col"))


POSITION_TO_LINE = "WITH m AS (SELECT doc_id, text, substring(text, 1, length(text) // 2) AS head FROM documents) SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(string_split(head, chr(10))[-1]) + 1 AS col FROM m"


def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.line_starts(passages(spark, sf_dir).select("doc_id", "text"))


LINE_STARTS = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), u AS (SELECT doc_id, unnest(lines) AS body, unnest(range(1, len(lines) + 1)) AS line FROM l) SELECT doc_id, line, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select(F.col("path").alias("source"), "text")


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.chunk(_sources(spark, sf_dir))
    return found.select("source", "start", "end", "start_line", "end_line", F.concat_ws(" > ", "headings").alias("headings"), "chunk_hash", "passage_id")


#: How a turn of a conversation is written as Markdown: by its number, as headings of both kinds, and fences that hold no headings.
_TURN_FORMS = (
    r"concat('## ', role, ' ', turn, ' ##\n', text, '\n')",
    r"concat('```\n# ', role, '\n', text, '\n```` \n')",
    r"concat(role, ' ', turn, '\n---\n===\n===\n', text, '\n')",
    r"concat('####\t', role, '\n~~~ x\n```\n# no\n', text, '\n ~~~\n')",
)
_TURN = "CASE " + " ".join(f"WHEN turn % 4 = {k} THEN {form}" for k, form in enumerate(_TURN_FORMS)) + " END"


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the documents, and of conversations that are written as Markdown."""
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select("conv_id", "turn", F.expr(_TURN).alias("piece"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("s"))
    written = ordered.select(F.concat(F.lit("conversation/"), "conv_id").alias("source"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n"), F.array_join(F.transform("s", lambda x: x["piece"]), "")).alias("text"))
    found = sections.sections(_sources(spark, sf_dir).unionByName(written))
    return found.select("source", "start", "line", F.concat_ws(" > ", "headings").alias("headings"), F.length("body").cast("long").alias("size"), F.sha2("body", 256).alias("body_sha256"))


_SPACES = r"[\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_ATX_SQL = r"^ {0,3}(#{1,6})(?:[ \t]+([^\n\r\x{2028}\x{2029}]*?)|[ \t]*)$"
_TURN_SQL = _TURN.replace(r"\n", "\n").replace(r"\t", "\t")
# a recursive walk over the lines that may open or close a fence, then headings, each with those that no other has closed
MARKDOWN_SECTIONS = f"""WITH RECURSIVE {_CORPUS},
src AS (SELECT path AS source, coalesce(text, '') AS raw FROM corpus
 UNION ALL SELECT concat('conversation/', conv_id), concat('# Conversation ', conv_id, chr(10), string_agg({_TURN_SQL}, '' ORDER BY turn)) FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id),
body AS (SELECT source, regexp_replace(raw, '\\r\\n?', chr(10), 'g') AS text FROM src),
cutup AS (SELECT source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, len(string_split(text, chr(10))) AS n FROM body),
l AS (SELECT source, no, CASE WHEN no = 0 AND starts_with(line, chr(65279)) THEN substr(line, 2) ELSE line END AS line,
 sum(length(line) + 1) OVER (PARTITION BY source ORDER BY no) - length(line) - 1 AS start FROM cutup WHERE NOT (line = '' AND no = n - 1)),
mark AS (SELECT source, no, row_number() OVER (PARTITION BY source ORDER BY no) AS k, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS m, regexp_extract(line, '^ {{0,3}}(?:`{{3,}}|~{{3,}})(.*)$', 1, 's') AS rest
 FROM l WHERE regexp_matches(line, '^ {{0,3}}(`{{3,}}|~{{3,}})')),
walk AS (SELECT source, 0::BIGINT AS k, -1::BIGINT AS no, '' AS was, '' AS now FROM (SELECT DISTINCT source FROM mark)
 UNION ALL SELECT m.source, m.k, m.no, w.now, CASE
  WHEN w.now = '' THEN CASE WHEN m.m[1] = '`' AND contains(m.rest, '`') THEN '' ELSE m.m END
  WHEN m.m[1] = w.now[1] AND length(m.m) >= length(w.now) AND regexp_matches(m.rest, '^{_SPACES}*$') THEN '' ELSE w.now END
 FROM walk w JOIN mark m ON m.source = w.source AND m.k = w.k + 1),
f AS (SELECT l.source, l.no, l.line, l.start, coalesce(w.now <> '' OR (w.no = l.no AND w.was <> ''), FALSE) AS fenced FROM l ASOF LEFT JOIN walk w ON w.source = l.source AND w.no <= l.no),
c AS (SELECT *, NOT fenced AND regexp_matches(line, '{_ATX_SQL}') AS atx, NOT fenced AND regexp_matches(line, '^ {{0,3}}(=+|-+){_SPACES}*$') AS under,
 NOT fenced AND NOT regexp_matches(line, '{_ATX_SQL}') AND NOT regexp_matches(line, '^(    |\t|{_SPACES}*$)') AS plain FROM f),
b AS (SELECT *, coalesce(max(CASE WHEN NOT under THEN no END) OVER w, -1) AS base, lead(line) OVER w AS after, coalesce(lead(under) OVER w, FALSE) AS underlined FROM c WINDOW w AS (PARTITION BY source ORDER BY no)),
t AS (SELECT b.*, plain AND underlined AND (NOT under OR (no - base + coalesce(bp.p, 0)) % 2 = 1) AS setext FROM b LEFT JOIN (SELECT source AS s, no AS o, plain::INT AS p FROM c) bp ON bp.s = b.source AND bp.o = b.base),
h AS (SELECT source, no, start, CASE WHEN atx THEN length(regexp_extract(line, '{_ATX_SQL}', 1)) WHEN contains(after, '=') THEN 1 ELSE 2 END AS level,
 regexp_replace(CASE WHEN atx THEN regexp_replace(regexp_extract(line, '{_ATX_SQL}', 2), '(?:^|[ \t]+)#+[ \t]*$', '') ELSE line END, '^{_SPACES}+|{_SPACES}+$', '', 'g') AS title FROM t WHERE atx OR setext),
above AS (SELECT x.source, x.no, coalesce(string_agg(y.title, ' > ' ORDER BY y.no), '') AS headings FROM h x JOIN h y ON y.source = x.source AND y.no <= x.no
 WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.source = x.source AND z.no > y.no AND z.no <= x.no AND z.level <= y.level) GROUP BY ALL),
opened AS (SELECT h.source, h.no, h.start, a.headings FROM h JOIN above a USING (source, no)
 UNION ALL SELECT source, 0, 0, '' FROM l WHERE no = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.source = l.source AND h.no = 0)),
parts AS (SELECT o.*, substr(text, (start + 1)::BIGINT, (coalesce(lead(start) OVER (PARTITION BY o.source ORDER BY o.no), length(text)) - start)::BIGINT) AS part FROM opened o JOIN body USING (source))
SELECT source, start::BIGINT AS start, no::BIGINT AS line, headings, length(part)::BIGINT AS size, sha256(part) AS body_sha256 FROM parts"""


def chunk_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    return markdown.coverage(markdown.chunk(sources), sources)


CHUNK_COVERAGE_CHECK = f"WITH {_CORPUS} SELECT path AS source, TRUE AS ok FROM corpus"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_hash"))


def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector, the number of each taken for the hash of its input."""
    docs = passages(spark, sf_dir).select(F.col("doc_id").alias("chunk_hash"))
    return index.pending(docs, _stored(spark, sf_dir)).select(F.col("chunk_hash").alias("doc_id"))


PENDING_EMBEDDINGS = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"


def gc_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that no document with a positive quality label refers to."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_hash"))
    return index.unreferenced(_stored(spark, sf_dir), good).select(F.col("chunk_hash").alias("vec_id"))


GC_UNREFERENCED = "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = passages(spark, sf_dir).select(F.col("doc_id").alias("chunk_hash"), "source")
    return index.status(docs, docs, _stored(spark, sf_dir))


INDEX_STATUS = "SELECT count(*) AS passages, count(DISTINCT source) AS sources, count(*) FILTER (WHERE e.vec_id IS NULL) AS missing_vectors FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question searched from end to end in a prepared index, with the stand-in models."""
    model, root = providers.HashEmbedding(64), shared_path(spark, "index")
    index.prepare(spark, _sources(spark, sf_dir), root, model)
    asked = questions(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    opened = index.Index(spark, root, model)
    return search.search(spark, opened, asked, model, providers.SwappedExpansion(), providers.OverlapRerank())


def exact_excerpt_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    found = spans.locate_texts(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs)
    return found.select("item_id", F.col("id").alias("doc_id"), "start", "end", "unique_in_text")


EXACT_EXCERPT_MAPPING = "SELECT b.item_id, d.doc_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS \"end\", instr(substring(d.text, instr(d.text, b.text) + 1), b.text) = 0 AS unique_in_text FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0"


def pattern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every benchmark text in every document."""
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    found = patterns.places(wanted, passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return found.join(wanted, "pattern").select("item_id", F.col("id").alias("doc_id"), "start", "end")


PATTERN_PLACES = """
WITH pairs AS (SELECT item_id, doc_id, b.text AS pattern, d.text AS body FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
spots AS (SELECT *, unnest(range(0, length(body) - length(pattern) + 1)) AS p FROM pairs)
SELECT item_id, doc_id, p::BIGINT AS start, (p + length(pattern))::BIGINT AS "end" FROM spots WHERE substring(body, (p + 1)::INT, length(pattern)::INT) = pattern
"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up spans: 400 characters from each third of a text."""
    size = F.length("text")
    return passages(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"), size.alias("size")).select("doc_id", "k", F.floor(F.col("size") * F.col("k") / 3).alias("start"), (F.floor(F.col("size") * F.col("k") / 3) + 400).alias("end"))


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up spans: 60 characters at every 500th."""
    last = F.floor(F.length("text") / 500).cast("int")
    return passages(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("j")).select("doc_id", "j", (F.col("j") * 500).cast("long").alias("start"), (F.col("j") * 500 + 60).cast("long").alias("end"))


_WHOLE_SPANS = (
    "w AS (SELECT doc_id, k::INT AS k, (length(text) * k) // 3 AS s, (length(text) * k) // 3 + 400 AS e FROM documents CROSS JOIN range(3) t(k)), "
    "n AS (SELECT doc_id, j::INT AS j, j * 500 AS s, j * 500 + 60 AS e FROM (SELECT doc_id, unnest(range(length(text) // 500 + 1)) AS j FROM documents))"
)


def evidence_containment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.contained(_wide(spark, sf_dir), _narrow(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("outer_k").alias("k"), F.col("inner_j").alias("j"))


EVIDENCE_CONTAINMENT_WHOLE = f"WITH {_WHOLE_SPANS} SELECT w.doc_id, k, j FROM w JOIN n ON w.doc_id = n.doc_id AND w.s <= n.s AND w.e >= n.e"


def span_overlap_join_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.overlapping(_wide(spark, sf_dir), _narrow(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.col("a_k").alias("k"), F.col("b_j").alias("j"))


SPAN_OVERLAP_JOIN_WHOLE = f"WITH {_WHOLE_SPANS} SELECT w.doc_id, k, j FROM w JOIN n ON w.doc_id = n.doc_id AND w.s < n.e AND n.s < w.e"


# Evaluation


#: A labelled document is evidence for the items whose number leaves the same remainder.
DEALT = 40


def _judged_whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of the whole questions, and made-up evidence: labelled documents dealt by their number, found or not."""
    labels = table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    dealt = labels.select(F.col("doc_id").alias("evidence_id"), grade.alias("grade"), (F.col("doc_id") % DEALT).alias("hand"))
    evidence = questions(spark, sf_dir).select(F.col("item_id").alias("query_id"), (F.col("item_id") % DEALT).alias("hand")).join(dealt, "hand").drop("hand")
    return materialise(_lexical_lists(spark, sf_dir), "lists").select("query_id", "rank", F.col("id").alias("evidence_id")), evidence


_WHOLE_JUDGED = f"{_FIELDS}, {_WHOLE_ITEMS}, {_BM25}, ev AS (SELECT item_id AS query_id, doc_id AS evidence_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS grade FROM labels JOIN benchmark ON doc_id % {DEALT} = item_id % {DEALT})"


def ranked_metrics_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, evidence = _judged_whole(spark, sf_dir)
    return metrics.score_evidence(hits, evidence)


RANKED_METRICS_WHOLE = f"""
WITH {_WHOLE_JUDGED},
first AS (SELECT e.query_id, e.evidence_id, min(rank) AS rank, any_value(grade) AS grade FROM lex JOIN ev e ON e.query_id = lex.query_id AND e.evidence_id = lex.id WHERE rank <= 8 GROUP BY ALL),
br AS (SELECT query_id, rank, max(grade) AS grade, sum((grade > 0)::INT) AS spans FROM first GROUP BY ALL),
got AS (SELECT query_id, max((grade >= 2 AND rank <= 1)::INT) AS u1, max((grade >= 2 AND rank <= 3)::INT) AS u3, max((grade >= 2 AND rank <= 5)::INT) AS u5, max((grade >= 2 AND rank <= 8)::INT) AS u8,
  sum((CASE WHEN grade >= 2 THEN 3e0 WHEN grade = 1 THEN 1e0 ELSE 0e0 END) / log2(rank + 1)) AS dcg, sum(spans) AS spans FROM br GROUP BY ALL),
idr AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, evidence_id) AS rank FROM ev WHERE grade > 0),
ideal AS (SELECT query_id, sum((CASE WHEN grade >= 2 THEN 3e0 ELSE 1e0 END) / log2(rank + 1)) FILTER (WHERE rank <= 8) AS ideal, count(*) AS total FROM idr GROUP BY ALL)
SELECT q.query_id, CASE WHEN total > 0 THEN coalesce(u1, 0) END AS useful1, CASE WHEN total > 0 THEN coalesce(u3, 0) END AS useful3, CASE WHEN total > 0 THEN coalesce(u5, 0) END AS useful5, CASE WHEN total > 0 THEN coalesce(u8, 0) END AS useful8,
  CASE WHEN total > 0 THEN round(coalesce(dcg, 0) / ideal, 6) END AS ndcg8, CASE WHEN total > 0 THEN round(coalesce(spans, 0) / total, 6) END AS span_recall8,
  CASE WHEN EXISTS (SELECT 1 FROM lex WHERE lex.query_id = q.query_id) THEN 1 ELSE 0 END AS nonempty
FROM (SELECT DISTINCT query_id FROM ev) q LEFT JOIN ideal USING (query_id) LEFT JOIN got USING (query_id)
"""


def unit_novelty_ndcg_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit is a group of ten documents; a result earns its document's grade for the unit."""
    hits, evidence = _judged_whole(spark, sf_dir)
    unit = (F.floor(F.col("evidence_id") / 10)).alias("unit_id")
    credits = hits.join(evidence, ["query_id", "evidence_id"]).select("query_id", "rank", unit, "grade")
    units = evidence.select("query_id", unit, "grade").groupBy("query_id", "unit_id").agg(F.max("grade").alias("grade"))
    return metrics.score_units(credits, units)


UNIT_NOVELTY_NDCG_WHOLE = f"""
WITH {_WHOLE_JUDGED}, un AS (SELECT query_id, evidence_id // 10 AS unit_id, max(grade) AS grade FROM ev GROUP BY ALL),
cr AS (SELECT e.query_id, rank, evidence_id // 10 AS unit_id, max(grade) AS grade, max(CASE WHEN grade >= 2 THEN 3e0 WHEN grade = 1 THEN 1e0 ELSE 0e0 END) AS gain
  FROM lex JOIN ev e ON e.query_id = lex.query_id AND e.evidence_id = lex.id WHERE rank <= 8 GROUP BY ALL),
fr AS (SELECT query_id, rank, greatest(0e0, gain - coalesce(max(gain) OVER (PARTITION BY query_id, unit_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS fresh FROM cr),
d AS (SELECT query_id, sum(fresh / log2(rank + 1)) AS dcg FROM (SELECT query_id, rank, max(fresh) AS fresh FROM fr GROUP BY ALL) GROUP BY ALL),
idr AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, unit_id) AS rank FROM un WHERE grade > 0),
ideal AS (SELECT query_id, sum((CASE WHEN grade >= 2 THEN 3e0 ELSE 1e0 END) / log2(rank + 1)) FILTER (WHERE rank <= 8) AS ideal, count(*) AS total FROM idr GROUP BY ALL),
re AS (SELECT un.query_id, count(*) AS reached FROM un JOIN (SELECT query_id, unit_id, max(grade) AS got FROM cr GROUP BY ALL) b ON b.query_id = un.query_id AND b.unit_id = un.unit_id WHERE un.grade > 0 AND got >= un.grade GROUP BY ALL)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg8, round(coalesce(reached, 0) / total, 6) AS span_recall8 FROM ideal LEFT JOIN d USING (query_id) LEFT JOIN re USING (query_id)
"""


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), "event_type", "value")


def query_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of users with just five clicks; others are unknown, not zero."""
    return metrics.query_means(_timings(spark, sf_dir).where("event_type = 'click'"), 5)


QUERY_MEANS = "SELECT user_id AS question, CASE WHEN count(*) = 5 AND count(value) = 5 THEN round(avg(value), 6) END AS mean FROM events WHERE event_type = 'click' GROUP BY user_id"


def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    graded = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("mean")), "doc_id", "left")
    return metrics.summarise(graded.select("lang", "source", "mean"), ["lang", "source"])


SUMMARY_GROUPING_SETS = """
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS scope,
  coalesce(CASE WHEN grouping(lang) = 0 THEN lang END, CASE WHEN grouping(source) = 0 THEN source END, '') AS name,
  count(*) AS eligible, count(quality) AS scored, count(*) - count(quality) AS missing, round(avg(quality), 6) AS mean
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))
"""


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_timings(spark, sf_dir), "event_type", "value")


NEAREST_RANK_PERCENTILES = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS longest, count(value) AS n FROM events GROUP BY event_type"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def system(kind: str) -> DataFrame:
        return _timings(spark, sf_dir).where(F.col("event_type") == kind).groupBy("question").agg(F.round(F.avg("value"), 6).alias("mean"))

    return compare.paired(system("click"), system("error"))


_PAIRS = "l AS (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'click' GROUP BY user_id), r AS (SELECT user_id, round(avg(value), 6) AS m FROM events WHERE event_type = 'error' GROUP BY user_id), d AS (SELECT l.user_id AS question, r.m - l.m AS delta FROM l JOIN r USING (user_id) WHERE l.m IS NOT NULL AND r.m IS NOT NULL)"


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.outcome(_pairs(spark, sf_dir))


PAIRED_COMPARE = f"WITH {_PAIRS} SELECT count(*) AS questions, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta = 0) AS ties, count(*) FILTER (WHERE delta < 0) AS losses, round(avg(delta), 6) AS mean_delta FROM d"


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.bootstrap(materialise(_pairs(spark, sf_dir), "pairs"))


PAIRED_BOOTSTRAP = f"""
WITH RECURSIVE {_PAIRS}, a AS (SELECT list(delta ORDER BY question) AS deltas, count(*)::HUGEINT AS n FROM d),
jump(k, mul, inc) AS (SELECT 0::HUGEINT, 1::HUGEINT, 0::HUGEINT UNION ALL SELECT k + 1, mul * 1664525 % 4294967296, (inc * 1664525 + 1013904223) % 4294967296 FROM jump, a WHERE k < n),
step AS (SELECT mul, inc FROM jump, a WHERE k = n),
starts(sample, state) AS (SELECT 0, 20260905::HUGEINT UNION ALL SELECT sample + 1, (state * mul + inc) % 4294967296 FROM starts, step WHERE sample < 1999),
draws(sample, i, state, total) AS (SELECT sample, 0::HUGEINT, state, 0e0 FROM starts UNION ALL
  SELECT sample, i + 1, (state * 1664525 + 1013904223) % 4294967296, total + deltas[floor(((state * 1664525 + 1013904223) % 4294967296)::DOUBLE / 4294967296e0 * n::DOUBLE)::BIGINT + 1] FROM draws, a WHERE i < n),
means AS (SELECT list(total / n::DOUBLE ORDER BY total / n::DOUBLE) AS m FROM draws, a WHERE i = n)
SELECT round(m[51], 6) AS low, round(m[1951], 6) AS high FROM means
"""


def cohort_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of event against clicks, by the means of users: all comparisons and their intervals in one pass."""
    means = _timings(spark, sf_dir).groupBy("event_type", "question").agg(F.round(F.avg("value"), 6).alias("mean"))
    means = materialise(means, "means")
    kinds = means.where("event_type <> 'click'").select("event_type").distinct()
    left = means.where("event_type = 'click'").drop("event_type").join(F.broadcast(kinds))
    return compare.compare_groups(left, means.where("event_type <> 'click'"), ["event_type"])


COHORT_COMPARISONS = """
WITH RECURSIVE m AS (SELECT event_type, user_id AS question, round(avg(value), 6) AS m FROM events GROUP BY ALL), kinds AS (SELECT DISTINCT event_type AS g FROM m WHERE event_type <> 'click'),
l AS (SELECT g, question, m FROM m, kinds WHERE event_type = 'click'), r AS (SELECT event_type AS g, question, m FROM m WHERE event_type <> 'click'),
j AS (SELECT coalesce(l.g, r.g) AS g, coalesce(l.question, r.question) AS question, r.m - l.m AS delta FROM l FULL JOIN r ON l.g = r.g AND l.question = r.question),
a AS (SELECT g, list(delta ORDER BY question) AS deltas, count(*)::HUGEINT AS n FROM j WHERE delta IS NOT NULL GROUP BY g),
jump(g, k, mul, inc) AS (SELECT g, 0::HUGEINT, 1::HUGEINT, 0::HUGEINT FROM a UNION ALL SELECT g, k + 1, mul * 1664525 % 4294967296, (inc * 1664525 + 1013904223) % 4294967296 FROM jump JOIN a USING (g) WHERE k < n),
step AS (SELECT g, mul, inc FROM jump JOIN a USING (g) WHERE k = n),
starts(g, sample, state) AS (SELECT g, 0, 20260905::HUGEINT FROM a UNION ALL SELECT g, sample + 1, (state * mul + inc) % 4294967296 FROM starts JOIN step USING (g) WHERE sample < 1999),
draws(g, sample, i, state, total) AS (SELECT g, sample, 0::HUGEINT, state, 0e0 FROM starts UNION ALL
  SELECT g, sample, i + 1, (state * 1664525 + 1013904223) % 4294967296, total + deltas[floor(((state * 1664525 + 1013904223) % 4294967296)::DOUBLE / 4294967296e0 * n::DOUBLE)::BIGINT + 1] FROM draws JOIN a USING (g) WHERE i < n),
means AS (SELECT g, list(total / n::DOUBLE ORDER BY total / n::DOUBLE) AS m FROM draws JOIN a USING (g) WHERE i = n GROUP BY g)
SELECT j.g AS event_type, count(delta) AS questions, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta = 0) AS ties, count(*) FILTER (WHERE delta < 0) AS losses, round(avg(delta), 6) AS mean_delta,
  round(any_value(m[51]), 6) AS low, round(any_value(m[1951]), 6) AS high, count(*) FILTER (WHERE delta IS NULL) AS missing FROM j LEFT JOIN means ON means.g = j.g GROUP BY j.g
"""


def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.percentiles(_timings(spark, sf_dir), "event_type", "value")
    measured = found.select(F.concat("event_type", F.lit("_p95")).alias("gate"), F.col("p95").alias("value"))
    rules = spark.createDataFrame([("click_p95", "at_most", 60.0), ("error_p95", "at_least", 60.0), ("absent_p95", "at_most", 1.0)], "gate string, sense string, bound double")
    return compare.gates(measured, rules)


RELEASE_GATES = "WITH m AS (SELECT concat(event_type, '_p95') AS gate, quantile_disc(value, 0.95) AS value FROM events GROUP BY event_type), r(gate, sense, bound) AS (VALUES ('click_p95', 'at_most', 60e0), ('error_p95', 'at_least', 60e0), ('absent_p95', 'at_most', 1e0)) SELECT gate, CASE WHEN value IS NULL THEN 'INCONCLUSIVE' WHEN (sense = 'at_least' AND value >= bound) OR (sense = 'at_most' AND value <= bound) THEN 'PASS' ELSE 'FAIL' END AS status FROM r LEFT JOIN m USING (gate)"


def label_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


LABEL_ALLOCATION = "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL"


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the labels, dealt by number: the older lacks every seventh, the newer every fifth and judges every eleventh anew."""
    labels = table(spark, sf_dir, "labels")
    judged = F.when(F.col("doc_id") % 11 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return contract.changes(labels.where("doc_id % 7 <> 0"), labels.where("doc_id % 5 <> 0").withColumn("toxic", judged), ["doc_id"])


LABEL_CHANGES = """
WITH o AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, quality, CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 5 <> 0)
SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'lost' ELSE 'changed' END AS change, coalesce(o.doc_id, n.doc_id) AS doc_id, (o.doc_id IS NOT NULL)::BIGINT AS was, (n.doc_id IS NOT NULL)::BIGINT AS now
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.quality IS DISTINCT FROM n.quality OR o.toxic IS DISTINCT FROM n.toxic
"""


def replay_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of answers to labelled texts, met by a request for every text: what isn't answered or used, by digest and ordinal."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit(0).alias("place"), F.col("text").alias("request"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), "quality", "toxic")
    answered = docs.join(labels, "query_id").select("query_id", "place", "request", F.to_json(F.struct("quality", "toxic")).alias("answer"))
    # each labelled text was asked for twice when the record was made
    record = models.keyed("embed", answered.unionByName(answered.withColumn("place", F.lit(1))))
    return models.misses("embed", models.keyed("embed", docs), materialise(record, "record"))


REPLAY_MISSES = """
WITH d AS (SELECT doc_id, sha256('embed:' || text) AS digest FROM documents), asked AS (SELECT digest, row_number() OVER (PARTITION BY digest ORDER BY doc_id) - 1 AS ordinal FROM d),
record AS (SELECT digest, row_number() OVER (PARTITION BY digest ORDER BY doc_id, place) - 1 AS ordinal FROM d JOIN labels USING (doc_id), (VALUES (0), (1)) p(place))
SELECT 'request without answer' AS rule, digest, ordinal FROM asked ANTI JOIN record USING (digest, ordinal) UNION ALL SELECT 'answer without request', digest, ordinal FROM record ANTI JOIN asked USING (digest, ordinal)
"""


def cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as costs, those of searches unknown."""
    cost = F.when(F.col("event_type") != "error", F.col("value"))
    return compare.costs(_timings(spark, sf_dir).withColumn("cost", cost), "event_type", "cost")


COST_ACCOUNTING = "SELECT event_type, round(sum(coalesce(CASE WHEN event_type <> 'error' THEN value END, 0)), 6) AS known, count(*) FILTER (WHERE event_type = 'error' OR value IS NULL) AS unknown FROM events GROUP BY event_type"


ALL = (
    token_frequencies, path_field_terms, lexical_lengths, bm25_topk, cosine_topk, cosine_batch_top40, vector_validation, expanded_fusion, adapted_baseline,
    rerank_cutoff_top8, snippet_prefix, best_window_excerpt, source_hashes, passage_identity, position_to_line, line_starts, markdown_chunks, markdown_sections,
    chunk_coverage_check, pending_embeddings, gc_unreferenced, index_status, exact_excerpt_mapping, pattern_places, evidence_containment_whole,
    span_overlap_join_whole, query_means, summary_grouping_sets, nearest_rank_percentiles, paired_compare, paired_bootstrap, cohort_comparisons, release_gates,
    label_allocation, label_changes, cost_accounting, bm25_fielded_batch_whole, rrf_fusion_whole, protected_fusion_40_whole, expanded_fusion_batch,
    ablation_views, adapted_baseline_batch, ranked_metrics_whole, unit_novelty_ndcg_whole, search_hybrid, replay_misses,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: globals()[f.__name__.upper()] for f in ALL if f.__name__.upper() in globals()}
