"""Sharding over fixed virtual slots (native: SQL functions only).

Records are hashed into thousands of virtual slots; bytes are aggregated per
slot; a versioned slot-to-shard map says where a slot lives. Version 1 deals
slots in turn; each rebalance edits the map and moves only the slots that the
overloaded shards have beyond the mean (law ``bytes``: sizes near equal). The map
is a stored table: a run writes its version, and takes an earlier one to edit.

Equal texts may lie in different shards: a group of copies can hold a third of
all rows, and kept together it would break the law.

Edge cases: a null text has no bytes (size 1, crc 0); rows without an id are
spread by their text (equal texts without an id share a slot); rows that repeat
an id and text share a slot and still get places of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table

SLOTS = 4096
SHARDS = 16


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("long"), F.xxhash64(text))), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of every virtual slot, empty ones too: exactly ``slots`` rows."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    used = records.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return every.join(F.broadcast(used), "vslot", "left").select("vslot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def first_map(stats: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: slots dealt in turn."""
    return stats.select("vslot", "n", "bytes", (F.col("vslot") % shards).alias("shard"), F.lit(1).alias("version"))


def rebalanced(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map. ``slots`` rows in, ``slots`` rows out.

    A shard keeps its largest slots up to the mean load; what lies beyond goes,
    largest first, to the shard that is lightest at that point. The fold runs
    over one array of at most ``slots`` entries.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(float(shards))
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = slot_map.withColumn("stays", (F.col("shard") < shards) & (kept <= mean)).select("vslot", "n", "bytes", "shard", "version", "stays")
    whole = marked.agg(
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), F.col("vslot"))))).alias("pool"),
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long").alias(f"load{s}") for s in range(shards)],
    )

    def place(state: Column, item: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda x, i: F.when(i == lightest, x - item["minus"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["picks"], F.array(F.struct(item["vslot"].alias("vslot"), lightest.alias("to")))).alias("picks"))

    start = F.struct(F.array(*[F.col(f"load{s}") for s in range(shards)]).alias("loads"), F.expr("cast(array() as array<struct<vslot:int,to:int>>)").alias("picks"))
    moves = whole.select(F.inline(F.aggregate("pool", start, place, lambda s: s["picks"])))
    return marked.join(F.broadcast(moves), "vslot", "left").select("vslot", "n", "bytes", F.coalesce("to", "shard").cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def edited_map(records: DataFrame, folder: str | None = None, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The stored map that places the records. ``folder`` holds the versions so far, as <folder>/version=N; the newest is edited
    to the records' bytes and written as the next one, beside it. Without a folder version 1 deals slots in turn, and version 2 is written to the shared folder."""
    stats = slot_bytes(records, slots)
    if folder is None:
        return materialised(rebalanced(first_map(stats, shards), shards))
    old = records.sparkSession.read.parquet(folder)
    newest = old.agg(F.max("version").alias("n")).first()["n"]
    kept = old.filter(F.col("version") == newest).select("vslot", "shard", "version")
    rebalanced(stats.join(kept, "vslot"), shards).drop("version").write.parquet(f"{folder}/version={newest + 1}")
    return records.sparkSession.read.parquet(folder).filter(F.col("version") == newest + 1)


def sized_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot(F.col("doc_id"), text, slots).alias("vslot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, version, shard, slot (place in the shard, gapless from 0).

    Only (doc_id, size, crc) is shuffled, by virtual slot; a place is the rank
    inside the virtual slot plus the rows of the shard's earlier slots, so no
    task ever sees a whole shard. The map has ``slots`` rows and is broadcast.
    """
    records = sized_records(docs, slots)
    current = edited_map(records, folder, shards, slots)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    current = current.withColumn("first_place", F.coalesce(before, F.lit(0))).select("vslot", "shard", "version", "first_place")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("rank", rank).join(F.broadcast(current), "vslot").select("doc_id", "size", "text_crc32", "vslot", "version", "shard", (F.col("first_place") + F.col("rank")).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
