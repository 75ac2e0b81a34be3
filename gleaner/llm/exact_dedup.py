"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table clustered and sorted by the digest of the normalised text. A batch
of new texts is reduced to one row per digest, held against the index by a sort-merge anti-join
(the index side needs no exchange, since its buckets are its partitions) and what is new is
appended, with the batch that it came in. Texts never move: only ids and digests are shuffled.
Groups that hold a large share of the rows are few, so they are joined back by a broadcast and the
rest by a sort-merge join.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tasks import column, whole_row, without
from gleaner.session import materialise, shared_path

#: A group with more than this share of the rows is hot; there are at most as many of them.
HOT = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text after lower-casing A-Z only; a null text counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """A digest table at ``path`` with one row per distinct text: digest, the id that stays, and
    the batch that brought it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index at ``path``, or create it there with ``buckets`` (64). The number is kept
        beside the table; opening it with another one is an error."""
        self.spark, self.path = spark, path
        self.buckets = self._fixed(buckets)
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _fixed(self, wanted: int | None) -> int:
        try:
            (found,) = self.spark.read.schema("buckets int").parquet(f"{self.path}-buckets").first()
        except AnalysisException:  # a new index
            found = wanted or 64
            self.spark.createDataFrame([(found,)], "buckets int").coalesce(1).write.parquet(f"{self.path}-buckets")
        if wanted and wanted != found:
            raise ValueError(f"the index at {self.path} has {found} buckets, not {wanted}")
        return found

    @classmethod
    def sized(cls, spark: SparkSession, path: str, rows: int) -> "DigestIndex":
        """A new index for about so many texts: half a million to a bucket."""
        return cls(spark, path, max(16, min(50_000, -(-rows // 500_000))))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, digests: DataFrame, batch: str) -> None:
        """Append those rows of ``(digest, keep_id)``, one per digest, that the index lacks.

        The new rows are written elsewhere first: a table can't be appended to while it is read. A
        batch that failed half-way can be appended again: what it has already brought is there.
        """
        fresh = digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh = materialise(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")), "digests")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> "DigestIndex":
        """The index rewritten with one sorted file per bucket, after many appends."""
        new = DigestIndex(self.spark, f"{self.path}-{shared_path(self.spark, 'c').rsplit('-', 1)[1]}", self.buckets)
        self.table().repartition(self.buckets, "digest").write.insertInto(new.name)
        self.spark.catalog.refreshTable(new.name)
        return new

    def close(self) -> None:
        """Forget the table's name in this session; the index stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide on every row of ``docs``: ``doc_id, text_sha256, keep_id, group_size, kept``.

    Within the batch the largest id of equal texts stays; a text that the index already has from
    an earlier batch stays under its earlier id, and all new copies go, even where their id is the
    earlier one. A retry must give the batch's name again: with it the same rows stay as in the
    first run; without it every call is a batch of its own. Null and empty texts are one group. A
    null id ranks below all others. Of rows that repeat both id and text exactly one is kept. An
    empty batch gives no rows and leaves the index as it was. Other columns are not read, whatever
    their names. The result doesn't read the index, which can be closed.
    """
    batch = batch or uuid.uuid4().hex
    rows = docs.select(column(id_col).alias("doc_id"), text_digest(column(text_col)).alias("digest"), F.monotonically_increasing_id().alias("tag"))
    rows = materialise(rows, "digested")
    last = F.coalesce(F.max_by("tag", "doc_id"), F.max("tag"))
    groups = materialise(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), last.alias("tag"), F.count("*").alias("group_size")), "groups")
    index.append_new(groups.select("digest", "keep_id"), batch)
    own = F.when(F.col("batch") == batch, F.col("tag"))
    decided = groups.drop("keep_id").join(index.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", own.alias("keep_tag"))
    decided = materialise(decided, "decided")
    total = decided.agg(F.sum("group_size")).first()[0] or 0
    hot = decided.where(F.col("group_size") > total / HOT)
    found = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(decided.where(F.col("group_size") <= total / HOT), "digest")
    kept = F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(False))
    return found.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that :func:`deduplicate` keeps, with all their columns.

    Ids none of whose rows stay are a list by which rows are dropped; texts are shuffled only for
    ids that repeat and of which some rows stay and some go.
    """
    decided = materialise(deduplicate(docs, index, batch, id_col, text_col), "decisions")
    ids = decided.groupBy("doc_id").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n"))
    ids = materialise(ids.where("stay < n"), "dropped")
    out = without(docs, ids.select("doc_id"), id_col)
    mixed = ids.where("stay > 0").select("doc_id")
    if not mixed.limit(1).count():
        return out
    pairs = decided.where("kept").join(mixed.withColumnRenamed("doc_id", "m_id"), F.col("doc_id").eqNullSafe(F.col("m_id")), "left_semi").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_digest"))
    packed = docs.select(whole_row(docs).alias("row"), column(id_col).alias("d_id"), text_digest(column(text_col)).alias("d_digest"))
    some = packed.join(pairs, F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_digest") == F.col("k_digest")), "left_semi")
    return out.unionByName(some.dropDuplicates(["d_id", "d_digest"]).select("row.*"))
