"""The corpus pipeline: language ID, exact, near and substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each result as
Parquet in the shared folder and gives what it reads back to the next. All but the last return the
columns of ``docs``; columns beside those of ``documents`` go along, whatever their names. An empty
table stays empty in every stage. Rows may repeat, and so may ids; ids may be null.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.exact_dedup import DigestIndex, keep_first
from gleaner.llm.language import UNDETERMINED, detect_languages, fit, with_letters
from gleaner.llm.packing import pack_documents
from gleaner.llm.queries import crc_of, table
from gleaner.llm.simhash import keep_dissimilar
from gleaner.llm.substring import cut_documents
from gleaner.session import materialise, shared_path, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter, and only these
    where no language could be learned.

    Whole texts are read. Rows with a null ``lang`` are judged, not learned from; with a null id they are
    judged too. Texts that no known n-gram is in stay.
    """
    ship(spark)
    filters = fit(docs.where(crc_of("doc_id") % 3 != 1))
    if not filters.languages:
        return with_letters(docs)
    return detect_languages(docs, filters).where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, that with the largest doc_id.

    Texts are equal when they are after lower-casing A-Z; null and empty texts are one group. A null id
    ranks below all others. Of rows that repeat id and text one stays; an id that repeats with
    different texts keeps those rows whose text it stands for.
    """
    ship(spark)
    index = DigestIndex.sized(spark, shared_path(spark, "digest-index"), docs.count())
    out = keep_first(docs, index)
    index.close()
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest doc_id.

    Documents are similar if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Candidates come from fingerprints of these sets in vantage-point trees, dealt by keys that similar sets
    share; each is verified by whole sets. What these miss is found by the prefixes of the sets in the order of their shingles' rarity, so
    no pair is left out. Texts without words are similar. Rows without an
    id stay, and no row goes because of them; rows that share an id stay or go together.
    """
    ship(spark)
    return keep_dissimilar(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller doc_id has too; n_chars follows the text.

    A passage is 13 words or more. A null id ranks after all others; rows that share an id leave each
    other's passages. Texts without a cut stay as they are, null ones too; a text all of whose words
    go becomes empty, its row stays.
    """
    ship(spark)
    return cut_documents(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens.

    Null and empty texts are one end token. Texts over a sequence's length are cut into full pieces and
    a rest. Repeated rows are packed each; null ids stay null. Only the columns of the packing are
    returned.
    """
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL has neither the language filters nor SimHash nor the tokens; tests hold a brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
