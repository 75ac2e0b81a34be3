"""The passage index: generations of Parquet tables, vectors that later generations reuse.

``<root>/vectors`` is append-only and keyed by chunk hash; ``<root>/generations/<id>`` holds the
tables of one generation; ``<root>/published`` has a version for each publication: the generation, and
the folder of its vectors. The latest version is the index. A generation that fails is never published,
so readers keep the last one. There may be several writers: each publishes on the version that it has
seen, and where another was first it takes its vectors along to the folder that counts now.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.errors import Code, EngineError
from gleaner.functions.vectors import norm, valid
from gleaner.operators.batching import greedy
from gleaner.operators.lexical import LexicalIndex, build_index
from gleaner.operators.numbering import numbered
from gleaner.operators.quality import lexical_violations, number_violations, span_violations, vector_violations
from gleaner.operators.similarity import pack_vectors
from gleaner.plans.versions import exists, latest, swap
from gleaner.session import buckets_at, materialise
from gleaner.sources.limits import Retrying
from gleaner.sources.markdown import Budget, chunk, coverage
from gleaner.sources.providers import Embedding, check_vectors

VECTORS = "profile string, chunk_hash string, embedding array<float>, norm double, generation string"
NAMES = [c.split()[0] for c in VECTORS.split(", ")]
#: Inputs and tokens of a request for vectors.
BATCH, BATCH_TOKENS = 32, 32_768


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _latest(spark: SparkSession, root: str) -> dict | None:
    found = latest(spark, f"{root}/published")
    return found[1] if found else None


def _size(profile: str) -> int:
    return int(profile.split(":")[-2])


def receipts(spark: SparkSession, root: str, profile: str, folder: str = "vectors") -> DataFrame:
    """Stored vectors of a profile with ``broken``: those of another size, zero or not finite, or whose norm isn't theirs."""
    rows, v = _read(spark, f"{root}/{folder}", VECTORS).where(F.col("profile") == profile), F.col("embedding")
    good = valid(v, _size(profile)) & (F.abs(F.col("norm") - norm(v)) <= 1e-6 * norm(v))
    return rows.withColumn("broken", ~F.coalesce(good, F.lit(False)))


def vectors(spark: SparkSession, root: str, profile: str, folder: str = "vectors") -> DataFrame:
    """One vector for each chunk hash of a profile: of sound ones that of the oldest generation.

    Broken receipts are passed over, so their inputs count as not embedded. Several receipts of a generation
    come from a repeated write; the first by value counts.
    """
    sound = receipts(spark, root, profile, folder).where(~F.col("broken"))
    first = sound.groupBy("chunk_hash").agg(F.min(F.struct("generation", "embedding", "norm")).alias("r"))
    return first.select(F.lit(profile).alias("profile"), "chunk_hash", "r.embedding", "r.norm", "r.generation")


def pending(passages: DataFrame, stored: DataFrame) -> DataFrame:
    """Passages whose input has no vector yet, one of each input."""
    return passages.join(stored.select("chunk_hash"), "chunk_hash", "left_anti").dropDuplicates(["chunk_hash"])


def unreferenced(stored: DataFrame, used: DataFrame) -> DataFrame:
    """Stored vectors (``chunk_hash``) that no used input refers to."""
    return stored.join(used.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def status(sources: DataFrame, passages: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: ``sources, passages, missing_vectors``, the inputs of passages that have no vector yet."""
    counts = passages.agg(F.count("*").alias("passages"))
    missing = pending(passages, stored).agg(F.count("*").alias("missing_vectors"))
    return sources.agg(F.countDistinct("source").alias("sources")).crossJoin(counts).crossJoin(missing)


def embed_pending(missing: DataFrame, provider: Embedding, profile: str, budget: Budget = Budget(), retry: Retrying = Retrying()) -> DataFrame:
    """Vectors of ``missing`` (chunk_hash, text), by batches of texts within each task.

    A batch ends before it would exceed ``BATCH`` texts or ``BATCH_TOKENS`` tokens. Failures that may
    pass are tried again.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            numbers = np.array(greedy(map(budget.soft, texts), BATCH, BATCH_TOKENS), np.int64)
            cuts = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                found = check_vectors(texts[a:b], retry.call(provider.embed, texts[a:b]), provider.size)
                yield pa.RecordBatch.from_arrays([pa.array([profile] * (b - a)), part.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.float32()))], ["profile", "chunk_hash", "embedding"])

    embedded = missing.select("chunk_hash", "text").mapInArrow(run, "profile string, chunk_hash string, embedding array<float>")
    return embedded.withColumn("norm", norm(F.col("embedding")))


def prepare(spark: SparkSession, sources: DataFrame, root: str, provider: Embedding, project: str = "project", budget: Budget = Budget()) -> dict:
    """Build and publish a generation from ``sources`` (source, text); returns counts."""
    profile = f"{provider.name}:{provider.size}:{budget.name}"
    generation = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    at = f"{root}/generations/{generation}"
    sources.select("source", "text").write.parquet(f"{at}/sources")
    kept = spark.read.parquet(f"{at}/sources")
    chunk(kept, project, budget).write.parquet(f"{at}/spans")
    spans = spark.read.parquet(f"{at}/spans")
    if coverage(spans, kept).where("not ok").limit(1).count():
        raise EngineError(Code.SOURCE_INVALID, "spans do not rebuild a source")
    passages = spans.where("passage_id is not null")
    if passages.groupBy("passage_id").count().where("count > 1").limit(1).count():
        raise EngineError(Code.SOURCE_INVALID, "a source is given twice")
    last = _latest(spark, root)
    folder = (last and last["folder"]) or "vectors"
    missing = materialise(pending(passages, vectors(spark, root, profile, folder)), "missing")
    embedded = missing.count()
    embed_pending(missing, provider, profile, budget).withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{root}/{folder}")
    now = vectors(spark, root, profile, folder)
    if passages.join(now.where(valid(F.col("embedding"), provider.size)), "chunk_hash", "left_anti").limit(1).count():
        raise EngineError(Code.INDEX_INVALID, "a passage has no valid vector")
    _write_read_path(spark, at, passages, now)
    total = passages.select("chunk_hash").distinct().count()


    def record(seen: dict | None) -> dict:
        other = (seen and seen["folder"]) or "vectors"
        if other != folder:  # garbage was collected meanwhile: what this generation needs goes along
            needed = passages.select("chunk_hash").distinct()
            lost = vectors(spark, root, profile, folder).join(needed, "chunk_hash", "left_semi").join(vectors(spark, root, profile, other).select("chunk_hash"), "chunk_hash", "left_anti")
            materialise(lost, "lost").select(*NAMES).write.mode("append").parquet(f"{root}/{other}")
        return {"generation": generation, "at": time.time_ns(), "profile": profile, "folder": other}

    swap(spark, f"{root}/published", record)
    return {"generation": generation, "passages": passages.count(), "inputs": total, "embedded": embedded}


def _write_read_path(spark: SparkSession, at: str, passages: DataFrame, stored: DataFrame) -> None:
    """What every search needs and none should make: numbers of passages, by which ties of all lists
    go, their vectors in blocks, postings and lengths by number, and the rarity of terms.

    Postings are bucketed by number and have their lengths with them, so scores of a batch are summed where they are read.
    """
    own = passages.select("passage_id", "chunk_hash", "source", "start", "end", "text", "headings")
    numbered(own, ["source", "start", "end", "passage_id"], "id").write.parquet(f"{at}/passages")
    kept = spark.read.parquet(f"{at}/passages")
    vectors = materialise(kept.select("chunk_hash", "id").join(stored, "chunk_hash").select("id", F.col("embedding").alias("v")), "keyed")
    pack_vectors(vectors).write.parquet(f"{at}/packed")
    lexical = build_index(kept.select("id", "text", F.concat_ws(" ", "headings").alias("heads"), "source"), "id", {"body": "text", "headings": "heads", "path": "source"}).saved(f"{at}/postings")
    lexical.lengths.write.parquet(f"{at}/lengths")
    lexical.stats.write.parquet(f"{at}/stats")
    spark.range(1).select(F.lit(lexical.parts).alias("buckets")).write.parquet(f"{at}/layout")
    n, df = kept.count(), F.col("df")
    lexical.postings.groupBy("field", "term").agg(F.count("*").alias("df")).write.parquet(f"{at}/frequency")
    counted = spark.read.parquet(f"{at}/frequency").where("field = 'body'")
    counted.select("term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/rarity")


class Index:
    """The published generation of an index folder."""

    def __init__(self, spark: SparkSession, root: str, provider: Embedding | None = None, budget: Budget = Budget(), checked: bool = True):
        """Open what is published at ``root``, if all its tables hold together, or as it is if not ``checked``."""
        last = _latest(spark, root)
        if not last:
            raise EngineError(Code.INDEX_NOT_READY, "nothing is published")
        self.spark, self.root, self.generation, self.profile = spark, root, last["generation"], last["profile"]
        self.folder = last["folder"] or "vectors"
        if provider and self.profile != f"{provider.name}:{provider.size}:{budget.name}":
            raise EngineError(Code.INDEX_INCOMPATIBLE, f"the index was made with {self.profile}")
        if checked:
            self.check()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/generations/{self.generation}/{name}")

    def passages(self) -> DataFrame:
        return self.table("spans").where("passage_id is not null")

    def lexical(self) -> LexicalIndex:
        """Postings and lengths by ``passage_id``."""
        names = self.numbered().select("id", "passage_id")
        posted, lengths = (self.table(t).join(names, "id").drop("id").withColumnRenamed("passage_id", "id") for t in ("postings", "lengths"))
        return LexicalIndex(posted, lengths, self.table("stats"))

    def by_number(self) -> LexicalIndex:
        """Postings, in their buckets, and lengths by the number of the passage."""
        path = f"{self.root}/generations/{self.generation}/postings"
        return LexicalIndex(buckets_at(self.spark, path, "id", self.table("layout").first()["buckets"]), self.table("lengths"), self.table("stats"), frequency=self.table("frequency"))

    def numbered(self) -> DataFrame:
        """Passages with ``id``, their number in the order of source and place."""
        return self.table("passages")

    def packed(self) -> DataFrame:
        """Vectors of the numbered passages in blocks."""
        return self.table("packed")

    def rarity(self) -> DataFrame:
        """``term, idf`` of terms of bodies."""
        return self.table("rarity")

    def embedded(self) -> DataFrame:
        """Passages with their vectors."""
        return self.passages().join(self.vectors(), "chunk_hash")

    def vectors(self) -> DataFrame:
        """One vector for each chunk hash of the profile."""
        return vectors(self.spark, self.root, self.profile, self.folder)

    def status(self) -> dict:
        found = status(self.table("sources"), self.passages(), self.vectors()).first()
        return {"sources": found["sources"], "passages": found["passages"], "missing_vectors": found["missing_vectors"], "profile": self.profile}

    def check(self) -> "Index":
        """The index itself if its tables hold together, else INDEX_INVALID."""
        size, lexical, numbers = _size(self.profile), self.by_number(), self.numbered()
        found = span_violations(self.table("spans"), self.table("sources"))
        found = found.unionByName(vector_violations(self.passages(), self.vectors(), size))
        found = found.unionByName(lexical_violations(lexical.postings, lexical.lengths, lexical.stats, numbers.select(F.col("id").alias("passage_id"))))
        found = found.unionByName(number_violations(numbers, self.passages()))
        broken = found.limit(1).collect()
        if broken:
            raise EngineError(Code.INDEX_INVALID, f"{broken[0]['rule']}: {broken[0]['subject']}")
        return self

    def collect_garbage(self) -> dict:
        """Publish a folder of just the vectors that the published generation refers to.

        They are written to a new folder, which counts from the moment that it is published with the
        generation; a run that dies before leaves everything as it was. Old folders stay for
        readers of the generation as it was, until they are deleted. Where another generation is published
        meanwhile, its vectors are collected instead.
        """
        counts: dict[str, int] = {}

        def record(seen: dict | None) -> dict:
            own = Index(self.spark, self.root, checked=False)
            stored = own.vectors()
            if pending(own.passages(), stored).limit(1).count():
                raise EngineError(Code.INDEX_INVALID, "a passage has no vector")
            removed = unreferenced(stored, own.passages())
            folder = f"vectors-{uuid.uuid4().hex[:8]}"
            stored.join(removed.select("chunk_hash"), "chunk_hash", "left_anti").select(*NAMES).write.parquet(f"{self.root}/{folder}")
            retained = self.spark.read.schema(VECTORS).parquet(f"{self.root}/{folder}").count()
            counts.update(removed=stored.count() - retained, retained=retained)
            if seen["generation"] != own.generation:  # published in between: the next try sees it
                return seen
            return {"generation": own.generation, "at": time.time_ns(), "profile": own.profile, "folder": folder}

        swap(self.spark, f"{self.root}/published", record)
        return counts
