"""Sharding by fixed virtual slots.

Ids hash into thousands of slots. Bytes are summed a slot, and a versioned map sends slots to shards: the
first version deals the largest slots first to the shard that has least, later ones move only the slots that
new shards need. Versions are stored in a folder, each once, and loaded by number. Only the map, one row a slot, is
ever handled as a whole; documents are never moved by it. Equal texts go by their ids like others: they needn't share a
shard, so that a large group of copies can't fill one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.llm.common import fresh, saved, text_or_empty
from shoal.operators import ranges

SLOTS = 4096


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    """A function of the id alone."""
    digits = F.substring(F.md5(doc_id.cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def slotted(rows: DataFrame, doc_id: str, size: Column, crc: Column, slots: int = SLOTS) -> DataFrame:
    """``rows`` with virtual_slot. Rows without an id go by size and crc of their text and their place among those of the same,
    so that no slot gets more than its share of them; only they are shuffled."""
    named = rows.where(F.col(doc_id).isNotNull()).withColumn("virtual_slot", virtual_slot(F.col(doc_id), slots))
    anonymous = rows.where(F.col(doc_id).isNull())
    if anonymous.select(doc_id).isEmpty():
        return named
    a, b, place = fresh(rows, "crc", "size", "place")
    anonymous = ranges.scanned(anonymous.withColumns({a: crc, b: size}), a, [b], place)
    return named.unionByName(anonymous.withColumn("virtual_slot", virtual_slot(F.concat_ws(":", F.lit("null"), F.col(b), F.col(a), F.col(place)), slots)).drop(a, b, place))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, n for all slots, empty ones too."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return every.join(got, "virtual_slot", "left").na.fill(0)


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """version 1: virtual_slot, shard, bytes, n. Slots go by falling bytes to the shard with the least so far."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "n"))
    )
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<struct<virtual_slot:int,shard:int,bytes:bigint,n:bigint>>").alias("map"),
    )

    def deal(acc: Column, s: Column) -> Column:
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        return F.struct(
            F.transform(acc["load"], lambda x, i: F.when(i == to, x + s["bytes"]).otherwise(x)).alias("load"),
            F.concat(acc["map"], F.array(F.struct(s["virtual_slot"].alias("virtual_slot"), to.alias("shard"), s["bytes"].alias("bytes"), s["n"].alias("n")))).alias("map"),
        )

    dealt = sizes.agg(ordered.alias("s")).select(F.inline(F.aggregate("s", zero, deal)["map"]))
    return dealt.select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "n")


def stored(slot_map: DataFrame, maps: str) -> int:
    """Stores a map of one version in the folder ``maps`` and gives its number; a version that is there is an error."""
    version = slot_map.first()["version"]
    slot_map.drop("version").coalesce(1).write.parquet(f"{maps}/version={version}")
    return version


def loaded(spark: SparkSession, maps: str, version: int | None = None) -> DataFrame:
    """The map of a version that is stored in ``maps``, or the last one."""
    every = spark.read.schema("virtual_slot int, shard int, bytes long, n long, version int").parquet(maps)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "n")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version for one shard more: each old shard gives its largest slots that fit in what it has above
    the new mean; every other slot stays. Sizes are taken anew from ``sizes``."""
    now = slot_map.select("version", "virtual_slot", "shard").join(sizes.select("virtual_slot", "bytes", "n"), "virtual_slot")
    own, run = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards + 1)
    moved = F.sum("bytes").over(run) <= F.sum("bytes").over(own) - mean
    return now.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n")


def numbered(rows: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with shard and slot, the gapless place within the shard: a count within the virtual slot after the
    rows of the shard's slots before it. No task handles more than a virtual slot."""
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    places = slot_map.withColumn("before", F.coalesce(before, F.lit(0))).drop("bytes", "n")
    own = Window.partitionBy("virtual_slot").orderBy(*order)
    return (
        rows.withColumn("own", F.row_number().over(own) - 1)
        .join(F.broadcast(places), "virtual_slot")  # one row a virtual slot, whatever the input
        .withColumn("slot", (F.col("before") + F.col("own")).cast("long"))
        .drop("before", "own")
    )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), *sized(text))
    return slotted(rows, "doc_id", F.col("size"), F.col("text_crc32"), slots)


def sized(text: str) -> tuple[Column, Column]:
    body = text_or_empty(text)
    return (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32")


def shard(docs: DataFrame, maps: str, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard for every row.

    Law ``bytes``: shards get nearly equal sizes, as near as whole virtual slots allow. Stores the map as version 1 in the
    folder ``maps``, and as version 2 its edit for one shard more, where a row goes to ``next_shard``. Null text has size
    1 and crc 0; rows with null ids are spread over the virtual slots (``slotted``); repeated rows lie side by side in one. Rows that tie on id, size and
    crc are numbered in any order. Very long texts are rows like others. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = saved(measured(docs, doc_id, text, slots), "sizes")
    now = loaded(spark, maps, stored(first_map(slot_sizes(rows, slots), shards), maps))
    grown = loaded(spark, maps, stored(rebalanced(now, now.select("virtual_slot", "bytes", "n"), shards), maps))
    both = now.join(grown.select("virtual_slot", F.col("shard").alias("next_shard")), "virtual_slot")
    return numbered(rows, both, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
        "next_shard",
    )


def assigned(docs: DataFrame, maps: str, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs``, all columns and rows, with shard, virtual_slot and map_version; columns of these names are replaced.

    A row's shard follows from its id and the map, one row a slot, so that texts of rows with ids aren't shuffled. The map is stored
    as version 1 in the folder ``maps``. Nulls, repeats and empty tables as in ``shard``.
    """
    sizes = slot_sizes(measured(docs, doc_id, text, slots), slots)
    slot_map = loaded(docs.sparkSession, maps, stored(first_map(sizes, shards), maps)).select("virtual_slot", "shard", F.col("version").alias("map_version"))
    plain = slotted(docs.drop("shard", "virtual_slot", "map_version"), doc_id, *sized(text), slots)
    return plain.join(F.broadcast(slot_map), "virtual_slot").select(*plain.columns[:-1], "shard", "virtual_slot", "map_version")
