"""Sharding through fixed virtual slots.

A record is hashed into one of ``SLOTS`` slots, and its slot never changes. What changes is
the map from slots to shards: it is dealt by the bytes of each slot, stored under a version,
and a rebalancing edits it, so that only the rows of the moved slots go elsewhere. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, written

#: Slots never change in number; a shard is a set of them.
SLOTS = 4096
SHARDS = 16
#: Rows of a slot are numbered in so many parts.
PARTS = 16
#: Rows equal in doc_id and text stay in one slot up to about so many.
COPIES = 1024
#: In a load, bytes count so much and a slot 1, so the number of slots decides between equal bytes.
BYTE = 2 * SLOTS

KEY, TIE = "_key", "_tie"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def record_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits of doc_id and text; a null is as an empty text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _number(key: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(key, first, digits), 16, 10).cast("long")


def slotted(rows: DataFrame, copies: int = COPIES) -> DataFrame:
    """``rows`` with virtual_slot, from the columns ``_key`` and ``_tie`` (any number, different in repeated rows).

    The slot is a hash of the record. Where a record is repeated more than ``copies`` times, its
    rows, which nothing tells apart, are dealt to several slots, so none holds a busy record.
    """
    busy = rows.groupBy(KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") > copies)
    salts = F.ceil(F.col("_n") / copies).cast("long")
    salt = F.pmod(F.xxhash64(TIE), salts)
    salted = F.when(F.col("_n").isNotNull() & (salt > 0), F.md5(F.concat_ws(":", KEY, salt))).otherwise(F.col(KEY))
    slot = F.pmod(_number(salted, 1, 8), F.lit(SLOTS)).cast("int")
    return rows.join(busy, KEY, "left").withColumn("virtual_slot", slot).drop("_n")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(slot, bytes, rows) of every slot, also of those without rows, from virtual_slot and size."""
    sizes = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    zero = F.lit(0).cast("long")
    return every.join(sizes, "slot", "left").select(
        "slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows")
    )


def _dealt(slots: DataFrame, shards: int, first: int = 0) -> DataFrame:
    """(slot, shard) from (slot, bytes, shard): slots with a shard stay there; the others, largest
    first, each go to the least loaded shard from number ``first`` on. One fold over the fixed
    number of slots, whatever the number of rows."""
    weight = F.col("bytes") * BYTE + 1
    order = F.struct(F.col("shard").isNull().alias("free"), (-weight).alias("less"), "slot", "shard")
    listed = slots.agg(F.sort_array(F.collect_list(order)).alias("slots"))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("chosen")
    )

    def place(state: Column, slot: Column) -> Column:
        open_to = F.slice(state["load"], first + 1, shards - first)
        least = F.array_position(open_to, F.array_min(open_to)).cast("int") + (first - 1)
        shard = F.coalesce(slot["shard"], least)
        load = F.transform(state["load"], lambda v, n: F.when(n == shard, v - slot["less"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["chosen"], F.array(shard)).alias("chosen"))

    chosen = F.aggregate("slots", empty, place, lambda state: state["chosen"])
    zipped = listed.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), chosen.alias("shard"))).alias("s"))
    return zipped.select("s.slot", "s.shard")


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(slot, shard): every slot dealt by size, so that shards hold nearly equal bytes; empty slots in turn."""
    return _dealt(sizes.withColumn("shard", F.when(F.col("bytes") == 0, F.col("slot") % shards)), shards)


def edited_map(now: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map ``now`` (slot, shard) edited for ``shards`` shards and the present ``sizes``.

    Every shard keeps its largest slots up to its part of all bytes; the rest move. With more
    shards than before they move to the new ones only; with as many, to the least loaded; with
    fewer, the slots of the shards that are gone move too. Empty slots move in turn. Slots are a
    fixed number, so the windows here are bounded.
    """
    known = now.join(sizes, "slot")
    total = sizes.agg((F.sum("bytes") * BYTE + F.count("*")).alias("all"), F.lit(shards).alias("n"))
    before = now.agg((F.max("shard") + 1).alias("shards")).first()["shards"] or 0
    own = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    held = known.withColumn("_held", F.sum(F.col("bytes") * BYTE + 1).over(own)).join(F.broadcast(total), F.lit(True))
    stays = (F.col("shard") < shards) & (F.col("_held") * F.col("n") <= F.col("all"))
    turn = F.col("slot") % shards
    empty = F.when((F.col("shard") >= shards) | (turn >= before), turn).otherwise(F.col("shard"))
    kept = held.select("slot", "bytes", F.when(F.col("bytes") == 0, empty).when(stays, F.col("shard")).alias("shard"))
    return _dealt(kept, shards, before if shards > before else 0)


def store_map(assignment: DataFrame, folder: str, version: int) -> None:
    """Store a version of the map; versions are never changed."""
    assignment.coalesce(1).write.parquet(f"{folder.rstrip('/')}/version={version}")


def stored_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, shard int").parquet(f"{folder.rstrip('/')}/version={version}")


def newest_version(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(folder).agg(F.max("version")).first()[0]


def prepared(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with size, ``_key`` and ``_tie``; clashing columns are replaced."""
    own = ["size", "virtual_slot", "shard", KEY, TIE, "_n"]
    start_with, end_with = numbered(docs, [c for c in docs.columns if c not in own])
    rows = docs.select(
        *start_with, size_of(F.col("text")).alias("size"), record_key(F.col("doc_id"), F.col("text")).alias(KEY),
        F.monotonically_increasing_id().alias(TIE),
    )
    return rows.select(*end_with, "size", KEY, TIE)


def sharded(docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Every row of ``docs`` with size, virtual_slot and shard under ``assignment`` (slot, shard), for writing shards.

    Null doc_ids and texts, empty texts and repeated rows are rows like others (a null text has
    size 1); no rows give no rows. Columns of the input with these names are replaced.
    """
    placed = slotted(prepared(docs)).join(assignment.withColumnRenamed("slot", "virtual_slot"), "virtual_slot")
    kept = [c for c in docs.columns if c not in ("size", "virtual_slot", "shard")]
    return placed.select(*[F.col(f"`{c}`") for c in kept], "size", "virtual_slot", "shard")


def positions(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """``rows`` (virtual_slot, ``_key``, ``_tie``, ...) with shard and the row's place ``slot`` in it, from 0 without gaps.

    Places run through the shard's slots and parts of slots: a part adds what lies before it, so
    no task numbers a whole shard.
    """
    mapped = rows.join(assignment.withColumnRenamed("slot", "virtual_slot"), "virtual_slot")
    mapped = mapped.withColumn("_part", F.pmod(_number(F.col(KEY), 9, 4), F.lit(PARTS)).cast("int"))
    parts = mapped.groupBy("shard", "virtual_slot", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("virtual_slot", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    inside = Window.partitionBy("virtual_slot", "_part").orderBy(KEY, TIE)
    ranked = mapped.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    return ranked.join(starts, ["virtual_slot", "_part"]).withColumn("slot", F.col("_base") + F.col("_rank"))


def manifest(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, shard, slot, virtual_slot, next_shard.

    Stores version 1 of the map, dealt for ``shards``, and version 2, edited for one shard more,
    in ``folder``; next_shard is the shard under version 2.
    """
    spark = docs.sparkSession
    ready = prepared(docs.select("doc_id", "text"))
    rows = written(ready.select("doc_id", "size", crc_of(F.col("text")).alias("text_crc32"), KEY, TIE), "records")
    placed = slotted(rows)
    sizes = written(slot_sizes(placed).coalesce(1), "slots")
    store_map(first_map(sizes, shards), folder, 1)
    now = stored_map(spark, folder, 1)
    store_map(edited_map(now, sizes, shards + 1), folder, 2)
    later = stored_map(spark, folder, 2).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("next_shard"))
    return positions(placed, now).join(later, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", "next_shard"
    )
