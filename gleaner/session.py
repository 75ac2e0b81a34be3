"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gleaner", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an
    error, because executors don't see one another's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/gleaner/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs one re-read instead of a recomputation, keeps
    a costly input from being computed for each of its consumers, and gives the planner the
    true size of the table, by which it picks the join strategy.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, tag: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Like ``materialise``, in buckets of ``key``: what is grouped by the key, or by it and more, isn't shuffled again."""
    spark = df.sparkSession
    name = f"gleaner_{tag}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path or shared_path(spark, tag)).saveAsTable(name)
    return _unnamed(spark, name)


def buckets_at(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """What :func:`bucketed` wrote at ``path``, still in its buckets."""
    name, kinds = f"gleaner_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kinds)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _unnamed(spark, name)


def _unnamed(spark: SparkSession, name: str) -> DataFrame:
    found = spark.table(name)
    found.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")  # only its name: files stay, and what was read from it
    return found


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of ``spark``, where it isn't yet.

    Workers see what is installed or on PYTHONPATH; a driver that was started in the repository
    sees more than that, so the package is sent along as an archive, once for each session.
    """
    root = Path(__file__).resolve().parent.parent
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or "site-packages" in root.parts or getattr(spark.sparkContext, "_gleaner_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="gleaner-ship-"), "gleaner"), "zip", root, "gleaner")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._gleaner_shipped = True
