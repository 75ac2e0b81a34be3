"""The queries of this subpackage, their SQL, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import shared_path, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS sequence FROM starts
), firsts AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY sequence) AS first_id FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM firsts WHERE first_id < doc_id
), tokens AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), kept AS (
  SELECT t.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY t.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM tokens t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.bpe import decode_documents, encode_documents

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def crc_of(column: str):
    """crc32 of a number as text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.toxicity import fit, score_documents

    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_of("doc_id") % 5 == 0
    grammar = fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = score_documents(docs, grammar)
    return scored.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.embedding import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, by plain cosine.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
), u AS (
  SELECT vec_id, label, e FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT src AS vec_id, src AS found FROM links UNION SELECT reach.vec_id, links.dst FROM reach JOIN links ON reach.found = links.src
), roots AS (
  SELECT vec_id, min(found) AS root FROM reach GROUP BY vec_id
), counts AS (
  SELECT src AS vec_id, count(*) AS n FROM links GROUP BY src
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.language import detect_languages, fit

    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), crc_of("doc_id") % 3 == 1
    found = detect_languages(docs.select("doc_id", "text"), fit(docs.where(~held)))
    found = found.select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str, map_path: str | None = None) -> DataFrame:
    """``map_path``: where the versions of the slot map are stored; a fresh place without it."""
    from gleaner.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), 24, map_path or shared_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.warc import archive_pages

    out = archive_pages(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), m AS (
  SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
         CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM m
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.exact_dedup import DigestIndex, deduplicate

    docs = table(spark, sf_dir, "documents")
    index = DigestIndex.sized(spark, shared_path(spark, "digest-index"), docs.count())
    out = deduplicate(docs, index)
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), d AS (
  SELECT part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
         (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
         (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS e, coalesce(quality = 1, FALSE)::INT AS good, coalesce(toxic = 1, FALSE)::INT AS toxic
  FROM w LEFT JOIN labels USING (doc_id)
), cells AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, step, o[step] AS filter FROM orders, range(1, 6) s(step) WHERE length(o) = 5
), long AS (
  SELECT part, n, good, toxic, o, step, filter,
         CASE filter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails, a + b + c + d + e AS failures,
         list_sum([CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END for x in string_split(o[1 : step - 1], '') if x <> '']) AS before
  FROM cells, steps
), found AS (
  SELECT part, o AS filter_order, step, filter,
         sum(CASE WHEN coalesce(before, 0) = 0 AND fails = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN coalesce(before, 0) = 0 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN before > 0 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = 1 AND failures = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN coalesce(before, 0) = 0 AND fails = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN coalesce(before, 0) = 0 AND fails = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM long GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM found
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.credentials import digest, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_sql() -> str:
    """All parts of a text by pattern, then each weak one against all others of its text."""
    from gleaner.llm.credentials import BREAK, KINDS, REACH

    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def matches(number: int, kind) -> str:
        p = quoted(kind.pattern)
        looks = "".join(f" AND regexp_matches(g, {quoted(x)})" for x in kind.looks)
        return f"""SELECT doc_id, {number} AS kind, nth, length(gap) AS gap, length(w) AS size, length(g) >= {kind.least}{looks} AS counts FROM (
          SELECT doc_id, unnest(range(1, len(ws) + 1)) AS nth, unnest(gaps[1 : len(ws)]) AS gap, unnest(ws) AS w, unnest(gs) AS g FROM (
            SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ws, regexp_extract_all(t, {p}, {kind.group}) AS gs FROM d WHERE regexp_matches(t, {p})))"""

    def some(test) -> str:
        return "(" + ", ".join(str(k) for k, kind in enumerate(KINDS) if test(kind)) + ")"

    def has(role: str) -> str:
        return f"coalesce(bool_or(s >= low AND e <= high AND NOT (s < w_e AND e > w_s) AND kind IN {some(lambda k: k.role == role)}), FALSE) AS has_{role}"

    names = "[" + ", ".join(quoted(k.name) for k in KINDS) + "][kind + 1] || ':' || s || ':' || e"
    base, at = some(lambda k: k.base), {k.name: n for n, k in enumerate(KINDS)}
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(matches(n, k) for n, k in enumerate((*KINDS, BREAK)))}),
placed AS (SELECT doc_id, kind, counts, size, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT AS e FROM m),
parts AS (SELECT doc_id, kind, e - size AS s, e FROM placed WHERE counts),
scoped AS (SELECT *, max(CASE WHEN kind = {len(KINDS)} THEN e END) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opens,
  min(CASE WHEN kind = {len(KINDS)} THEN s END) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closes FROM parts WINDOW h AS (PARTITION BY doc_id ORDER BY s, e)),
weak AS (SELECT doc_id, kind AS w_kind, s AS w_s, e AS w_e, greatest(s - {REACH}, coalesce(opens, 0), 0) AS low, least(e + {REACH}, coalesce(closes, e + {REACH})) AS high
  FROM scoped WHERE kind IN {some(lambda k: not k.base)}),
linked AS (SELECT weak.doc_id, w_kind, w_s, w_e, coalesce(bool_or(s < w_e AND e > w_s AND kind IN {base}), FALSE) AS known, {has("identifier")}, {has("secret")}, {has("endpoint")}
  FROM weak JOIN parts ON weak.doc_id = parts.doc_id AND kind < {len(KINDS)} GROUP BY ALL),
spans AS (SELECT doc_id, kind, s, e FROM parts WHERE kind IN {base} UNION ALL SELECT doc_id, w_kind, w_s, w_e FROM linked WHERE NOT known AND
  ((w_kind = {at["identifier"]} AND has_secret) OR (w_kind = {at["key"]} AND (has_identifier OR has_endpoint)) OR (w_kind = {at["endpoint"]} AND has_identifier AND has_secret))),
found AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg({names}, ',' ORDER BY s, kind) FILTER (WHERE kind IN {base}) AS base, string_agg({names}, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, m, words, unnest(range(1, len(words) - m + 2)) AS i FROM w, range(1, 5) s(m) WHERE len(words) >= m
), f AS (
  SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1 : c.m], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_sizes AS (
  SELECT lang, a, string_split(phrase, ' ') AS words, m, unnest(range(2, m)) AS size FROM f WHERE m > 2
), inner_phrases AS (
  SELECT lang, a, words, size, unnest(range(1, m - size + 2)) AS i FROM inner_sizes
), longer AS (
  SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, max(a) AS longest FROM inner_phrases GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE longest IS NULL OR 100 * longest < 80 * a QUALIFY rank <= 2000
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring, op2_bpe, op3_toxicity, op4_embedding, op5_language, op6_simhash, op7_packing, op8_sharding, op9_warc, op10_exact_dedup, op11_filter_audit, op12_secrets, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring": OP1_SQL, "op4_embedding": OP4_SQL, "op9_warc": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_secrets": op12_sql(), "op13_collocations": OP13_SQL}
