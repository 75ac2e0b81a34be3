"""Pinned corpora: a JSON manifest of projects and files, checked against the texts at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import lf

#: Fixed values of the manifest's format.
VERSION, PROJECTS, FOLDER = 1, 3, ".agent/knowledge/"
FILE = "struct<original:string,mapped:string,originalHash:string,normalizedHash:string,bytes:long>"
SCHEMA = f"version int, projects array<struct<id:string,url:string,commit:string,license:struct<status:string,files:array<struct<path:string,hash:string>>>,files:array<{FILE}>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``project, url, commit, license, notices, original, mapped, original_hash, normalised_hash, bytes``: a row a file.

    A project without files has one row whose file columns are null, so that checks see it.
    """
    root = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    projects = root.select("version", F.explode_outer("projects").alias("p"))
    rows = projects.select("version", "p", F.explode_outer("p.files").alias("f"))
    return rows.select(
        "version",
        F.col("p.id").alias("project"),
        F.col("p.url").alias("url"),
        F.col("p.commit").alias("commit"),
        F.col("p.license.status").alias("license"),
        F.col("p.license.files").alias("notices"),
        F.col("f.original").alias("original"),
        F.col("f.mapped").alias("mapped"),
        F.col("f.originalHash").alias("original_hash"),
        F.col("f.normalizedHash").alias("normalised_hash"),
        F.col("f.bytes").alias("bytes"),
    )


def _is(condition) -> F.Column:
    return F.coalesce(condition, F.lit(False))


def _safe(path) -> F.Column:
    return _is((F.length(path) > 0) & ~path.rlike(r"[\\\x00]") & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", "..")))


def manifest_violations(files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``rule, subject`` of every rule that the rows of :func:`read_manifest` break.

    ``sources`` (project, mapped, content binary), if given, are what was fetched: sizes and
    digests, as given and with line ends as line feeds, must be those of the manifest, and no
    file may be missing or left over.
    """
    projects = files.select("project", "url", "commit", "license", "notices").distinct()
    hexed = lambda c, n: _is(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"))
    notices = projects.select("project", F.explode("notices").alias("x"))
    count = files.agg(F.countDistinct("project").alias("n"), F.min("version").alias("low"), F.max("version").alias("high"))
    rules = {
        "version": count.where(~_is((F.col("low") == VERSION) & (F.col("high") == VERSION))).select(F.lit("manifest").alias("s")),
        "projects": count.where(F.col("n") < PROJECTS).select(F.lit("manifest").alias("s")),
        "project id": projects.where(~_is(F.col("project").rlike("^[a-z0-9-]+$"))).select("project"),
        "project repeated": projects.groupBy("project").count().where("count > 1").select("project"),
        "upstream": projects.where(~_is(F.col("url").rlike(r"^https://[\w.-]+/[\w.-]+/[\w.-]+$"))).select("project"),
        "commit": projects.where(~hexed("commit", 40)).select("project"),
        "license": projects.where(F.col("license").isNull() | F.col("notices").isNull()).select("project"),
        "notice": notices.where(~_is(F.col("x.hash").rlike("^[0-9a-f]{64}$") & _safe(F.col("x.path")))).select("project"),
        "path": files.where(~(_safe(F.col("original")) & _is(F.col("original").endswith(".md")))).select("project"),
        "mapping": files.where(~_is(F.col("mapped") == F.concat(F.lit(FOLDER), "original"))).select("project"),
        "file repeated": files.groupBy("project", "mapped").count().where("count > 1").select("mapped"),
        "digest": files.where(~(hexed("original_hash", 64) & hexed("normalised_hash", 64))).select("mapped"),
        "size": files.where(~_is(F.col("bytes") > 0)).select("mapped"),
    }
    if sources is not None:
        keys = ["project", "mapped"]
        both = files.join(sources.select(*keys, "content"), keys)
        text = F.try_validate_utf8(F.col("content").cast("string"))
        rules |= {
            "file missing": files.join(sources, keys, "left_anti").select("mapped"),
            "file left over": sources.join(files, keys, "left_anti").select("mapped"),
            "size differs": both.where(F.octet_length("content") != F.col("bytes")).select("mapped"),
            "digest differs": both.where(F.sha2("content", 256) != F.col("original_hash")).select("mapped"),
            "normalised digest differs": both.where(~_is(F.sha2(lf(text), 256) == F.col("normalised_hash"))).select("mapped"),
        }
    out = None
    for rule, rows in rules.items():
        own = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).cast("string").alias("subject"))
        out = own if out is None else out.unionByName(own)
    return out
