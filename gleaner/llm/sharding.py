"""Sharding by fixed virtual slots: record -> slot by hash, slot -> shard by a versioned map.

Records are hashed into ``slots`` virtual slots, a number that never changes. Bytes are summed per
slot, and a map assigns whole slots to shards, largest slot first to the least loaded shard. The
map is a small table (one row per slot, so its size is bounded by ``slots``) with a version;
rebalancing writes the next version, in which only the slots that have to move differ.
Documents are placed by the latest stored version; where the number of shards has changed, slots
have come that it doesn't know, or its largest load lies too far above what a fresh map would
have, the next version is written first. All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.tasks import column
from gleaner.plans.versions import exists
from gleaner.session import materialise

#: Virtual slots, and parts of all rows that are numbered apart at least: a larger slot is divided.
SLOTS, PARTS = 4096, 1024
#: How far the largest load may lie above that of a fresh map before the stored one is rebalanced.
SLACK = 0.05
MAP = "virtual_slot int, shard int, shards int, version int"
COLUMNS = ("version", "shards", "virtual_slot", "shard")


def virtual_slot(key: Column, slots: int = SLOTS, otherwise: Column | None = None) -> Column:
    """The slot of a record key; records with a null key are dealt by ``otherwise``, or share one slot."""
    key = F.xxhash64(key) if otherwise is None else F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.xxhash64(otherwise))
    return F.pmod(key, F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def slot_sizes(sized: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, records`` of ``(virtual_slot, size)``: at most a row for each slot."""
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def _deal(slots: DataFrame, loads: Column) -> DataFrame:
    """Give slots (``virtual_slot, bytes``) to shards, largest first, always to the least loaded.

    ``loads``: what the shards hold already, an array of longs. A fold over one array of as many
    elements as there are virtual slots.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"))))
    zero = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(acc: Column, x: Column) -> Column:
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loaded = F.transform(acc["loads"], lambda v, i: F.when(i == at, v - x["less"]).otherwise(v))
        return F.struct(loaded.alias("loads"), F.concat(acc["shards"], F.array(at)).alias("shards"))

    dealt = slots.agg(order.alias("o")).select("o", F.aggregate("o", zero, step)["shards"].alias("s"))
    return dealt.select(F.explode(F.arrays_zip("o", "s")).alias("x")).select(F.col("x.o.virtual_slot").alias("virtual_slot"), F.col("x.s").alias("shard"))


def first_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """A map made anew: ``version, shards, virtual_slot, shard`` for every slot that holds records."""
    dealt = _deal(sizes.select("virtual_slot", "bytes"), F.array_repeat(F.lit(0).cast("long"), shards))
    return dealt.select(F.lit(version).cast("int").alias("version"), F.lit(shards).cast("int").alias("shards"), "virtual_slot", "shard")


def rebalance(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards and the present sizes of the slots.

    A shard keeps its slots, largest first, up to the mean load, and its largest slot and empty slots
    in any case; what lies above it, slots of shards that no longer exist, and slots new since the
    old map are dealt to the least loaded. So what moves is small, and evens out the loads.
    """
    now = sizes.select("virtual_slot", "bytes").join(old.select("virtual_slot", "shard"), "virtual_slot", "left")
    mean = sizes.agg((F.sum("bytes") / shards).alias("mean"))
    total = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot"))
    fits = (F.col("upto") <= F.col("mean")) | (F.col("upto") == F.col("bytes")) | (F.col("bytes") == 0)
    held = now.withColumn("upto", total).crossJoin(F.broadcast(mean)).withColumn("stays", F.coalesce((F.col("shard") < shards) & fits, F.lit(False)))
    held = materialise(held, "held")
    version = old.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    sums = {r["shard"]: r["b"] for r in held.where("stays").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    loads = F.array(*[F.lit(sums.get(k, 0)).cast("long") for k in range(shards)])
    moved = _deal(held.where("not stays").select("virtual_slot", "bytes"), loads)
    kept = held.where("stays").select("virtual_slot", "shard")
    return kept.unionByName(moved).select(F.lit(version).cast("int").alias("version"), F.lit(shards).cast("int").alias("shards"), "virtual_slot", "shard")


def largest_load(table: DataFrame, sizes: DataFrame) -> int:
    """Bytes of the fullest shard when ``sizes`` are placed by a map; 0 without slots."""
    loads = sizes.join(table, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    return loads.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the map stored at ``path``; none where nothing is stored. A folder that is
    there and can't be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], MAP).select(*COLUMNS)
    return spark.read.schema(MAP).parquet(path).select(*COLUMNS)


def save_map(table: DataFrame, path: str) -> None:
    """Add a version of the map to the table of versions at ``path``; one that is there already is
    an error, and stays as it is."""
    table = materialise(table, "map")
    stored = versions(table.sparkSession, path).select("version").distinct()
    if table.join(stored, "version", "left_semi").limit(1).count():
        raise ValueError(f"the map at {path} has that version already")
    table.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default: ``version, shards, virtual_slot, shard``."""
    table = versions(spark, path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def current_map(sizes: DataFrame, shards: int, path: str, slack: float = SLACK) -> DataFrame:
    """The version to place records by: the latest stored one if it is for ``shards`` shards, knows
    all slots of ``sizes`` and has no load above ``1 + slack`` times the largest of a fresh map;
    else the next one, which is stored.

    The next version is a rebalanced one, or, where that would pass the bound too, a fresh one.
    """
    spark = sizes.sparkSession
    old = load_map(spark, path)
    have = old.agg(F.max("version").alias("version"), F.coalesce(F.max("shards"), F.max("shard") + 1).alias("shards")).first()
    if have["version"] is None:
        save_map(first_map(sizes, shards), path)
        return load_map(spark, path)
    fresh = materialise(first_map(sizes, shards, have["version"] + 1), "fresh")
    bound = (1 + slack) * largest_load(fresh, sizes)
    if have["shards"] == shards and largest_load(old, sizes) <= bound and not sizes.join(old, "virtual_slot", "left_anti").limit(1).count():
        return old
    unused = old.join(sizes, "virtual_slot", "left_anti").select("virtual_slot", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("records"))
    new = materialise(rebalance(old, sizes.unionByName(unused), shards), "rebalanced")
    save_map(fresh if largest_load(new, sizes) > bound else new, path)
    return load_map(spark, path)


def place(rows: DataFrame, table: DataFrame, sizes: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """Add ``shard, slot, map_version`` to rows that have ``virtual_slot`` and ``tag``, any number.

    ``slot`` is the place in the shard, without gaps from 0: the slots of a shard follow one
    another. A slot with more than one in ``parts`` of all rows is divided by ``tag`` into parts,
    which follow one another too. Rows are numbered within their part by ``order``, so that no task
    sorts a whole shard, nor a slot that a key with many rows fills. What is broadcast has
    at most a row for each virtual slot and for each of ``parts`` parts.
    """
    total = sizes.agg(F.sum("records")).first()[0] or 1
    divided = sizes.select("virtual_slot", F.ceil(F.col("records") * parts / total).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(divided), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int"))
    counted = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).join(F.broadcast(table), "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n")
    starts = counted.select("virtual_slot", "part", "shard", F.col("version").alias("map_version"), before.alias("starts"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(*order)) - 1
    placed = rows.withColumn("nth", nth).join(F.broadcast(starts), ["virtual_slot", "part"])
    return placed.withColumn("slot", F.col("starts") + F.col("nth")).drop("starts", "nth", "part", "parts")


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard so that shards hold nearly equal bytes.

    Returns ``doc_id, size, text_crc32, virtual_slot, shard, slot, map_version``. The map at
    ``map_path`` is used as it is stored, made if there is none, and rebalanced into the next version
    if it is for another number of shards, lacks slots, or has become uneven (``current_map``); so a
    second run places the same records alike. Null texts have size 8 and the checksum of no bytes; rows with a null id are dealt
    one by one; repeated rows each get a place of their own; an empty table gives no
    rows and stores no map. Other columns are not read, whatever their names. Equal texts
    are not held together: they are dealt by their ids like all others. A virtual slot is never
    divided between shards, so a single key that holds more than a shard's share stays in one shard.
    """
    text = column(text_col)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(column(id_col).alias("doc_id"), record_size(text).alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("tag"))
    rows = materialise(rows.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), slots, F.struct("text_crc32", "tag"))), "sized")
    sizes = materialise(slot_sizes(rows), "sizes")
    return place(rows, current_map(sizes, shards, map_path), sizes, ["doc_id", "text_crc32", "size", "tag"]).drop("tag")
