"""Fixed virtual slots: records hash into thousands of slots, bytes are summed per
slot, and a versioned slot-to-shard map is stored and edited when rebalancing.

Only DataFrame functions. The map has ``n_slots`` rows whatever the input's size, one for
every slot, so a record that comes later has a shard too. A stored map is read and kept:
a second run over the same folder gives the same shards. ``grow`` and ``rebalance`` store
the next version and move few slots; older versions stay readable.

Defined results: a null text has 0 bytes and the CRC of an empty text; rows of null
``doc_id`` are dealt by their text; equal rows take different positions; an empty table
gives an empty result (and a map of empty slots); further columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import new_folder, stage_table

N_SLOTS = 4096
ROW_OVERHEAD = 16
#: Positions are numbered in so many parts of a slot at once.
SUB_SLOTS = 16

_MAP = "vslot int, shard int, bytes bigint, version int"


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def record_sizes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and part of the slot of every row; texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text_crc32", "size"))
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("sub")), F.lit(SUB_SLOTS)).cast("int")
    return sized.select("*", virtual_slot(key, n_slots).alias("vslot"), sub.alias("sub"))


def slot_totals(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def assign_slots(totals: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 of the map (vslot, shard, bytes, version): slots in falling order of bytes, each to
    the shard with the fewest bytes so far, ties to the lower number; empty slots in turn."""
    every = totals.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("vslot")).join(totals, "vslot", "left").na.fill(0, ["bytes"])
    ordered = F.array_sort(F.collect_list(F.when(F.col("bytes") > 0, F.struct((-F.col("bytes")).alias("minus_bytes"), "vslot"))))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
        F.array().cast("array<int>").alias("shards"),
    )

    def deal(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: load - F.when(i == to, slot["minus_bytes"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(to)).alias("shards"))

    dealt = every.agg(ordered.alias("slots")).select("slots", F.aggregate("slots", start, deal, lambda state: state["shards"]).alias("shards"))
    pairs = dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select(F.col("x.slots.vslot").alias("vslot"), F.col("x.shards").alias("to"))
    shard = F.coalesce("to", F.pmod("vslot", F.lit(n_shards))).cast("int")
    return every.join(pairs, "vslot", "left").select("vslot", shard.alias("shard"), "bytes", F.lit(1).alias("version"))


def with_bytes(slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """The map with the bytes that the slots hold now."""
    now = totals.select("vslot", F.col("bytes").alias("now_"))
    return slot_map.join(now, "vslot", "left").select("vslot", "shard", F.coalesce("now_", F.lit(0)).alias("bytes"), "version")


def add_shard(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version for ``n_shards + 1`` shards. Each shard above the new mean gives slots, small
    ones first, as long as it does not fall below the mean and the new shard, all in all, does not
    exceed it; no other slot moves. Windows are over the map's rows, ``n_slots`` at most."""
    everything = W.partitionBy()
    along = lambda of: of.rowsBetween(W.unboundedPreceding, 0)
    mean = F.sum("bytes").over(everything) / (n_shards + 1)
    excess = F.sum("bytes").over(W.partitionBy("shard")) - F.col("mean_")
    given = F.sum("bytes").over(along(W.partitionBy("shard").orderBy("bytes", "vslot")))
    rated = slot_map.withColumn("mean_", mean).withColumn("offered_", (given <= excess) & (F.col("bytes") > 0))
    taken = F.sum(F.when(F.col("offered_"), F.col("bytes")).otherwise(0)).over(along(W.orderBy("bytes", "vslot")))
    moves = F.col("offered_") & (F.col("taken_") <= F.col("mean_"))
    return rated.withColumn("taken_", taken).select("vslot", F.when(moves, n_shards).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", (F.col("version") + 1).alias("version"))


def rebalance(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version, for slots whose bytes have changed: shards above the mean give slots, small
    ones first, down to the mean; those go, in falling order of bytes, to the shards with the most room.
    No shard rises above the mean by it but for its last slot."""
    everything, shard = W.partitionBy(), W.partitionBy("shard")
    every = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    mean = F.sum("bytes").over(everything) / n_shards
    given = F.sum("bytes").over(shard.orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0))
    rated = slot_map.withColumn("excess_", F.sum("bytes").over(shard) - mean).withColumn("moves_", (given <= F.col("excess_")) & (F.col("bytes") > 0))
    gone = F.sum(F.when(F.col("moves_"), F.col("bytes")).otherwise(0))
    kept = rated.groupBy("shard").agg((F.sum("bytes") - gone).alias("load"))
    mean_of = slot_map.agg((F.sum("bytes") / n_shards).alias("mean_"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # the room of the shards, end to end, is filled by the moved slots, end to end
    room = every.join(kept, "shard", "left").join(F.broadcast(mean_of)).select("shard", F.greatest(F.col("mean_") - F.coalesce("load", F.lit(0)), F.lit(0.0)).alias("room"))
    room = room.withColumn("from_", F.coalesce(F.sum("room").over(before), F.lit(0.0))).where("room > 0")
    order = W.orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, -1)
    moved = rated.where("moves_").select("vslot", "bytes", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("at_"))
    fits = (F.col("at_") >= F.col("from_")) & (F.col("at_") < F.col("from_") + F.col("room"))
    to = moved.join(F.broadcast(room), fits).select("vslot", F.col("shard").alias("to_"))  # a row a shard
    return slot_map.join(to, "vslot", "left").select("vslot", F.coalesce("to_", "shard").cast("int").alias("shard"), "bytes", (F.col("version") + 1).alias("version"))


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Adds a version to the stored map; a version that is stored already is an error."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """A version of the stored map, the latest by default; None if none is stored."""
    try:
        stored = spark.read.schema(_MAP).parquet(folder)
        version = version or stored.agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return stored.where(F.col("version") == version) if version else None


def grow(spark: SparkSession, folder: str) -> DataFrame:
    """Stores and returns the next version, with one shard more."""
    last = load_map(spark, folder)
    store_map(add_shard(last, last.agg(F.max("shard")).first()[0] + 1), folder)
    return load_map(spark, folder)


def shard_records(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, folder: str | None = None, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position in the shard, without gaps from 0),
    vslot, map_version. The map in ``folder`` decides (its latest version or the one given); it is
    made from these records only where none is stored. Positions are the sums of the counts of the
    shard's earlier parts of slots plus a number within the part, so no task sees a whole shard."""
    spark = docs.sparkSession
    sizes = stage_table(record_sizes(docs, n_slots), "shard-sizes")
    folder = folder or new_folder(spark, "slot-map")
    slot_map = load_map(spark, folder, version)
    if slot_map is None:
        store_map(assign_slots(slot_totals(sizes), n_shards, n_slots), folder)
        slot_map = load_map(spark, folder)
    before = W.partitionBy("shard").orderBy("vslot", "sub").rowsBetween(W.unboundedPreceding, -1)
    counts = sizes.groupBy("vslot", "sub").agg(F.count(F.lit(1)).alias("n_"))
    bases = counts.join(F.broadcast(slot_map.select("vslot", "shard", "version")), "vslot").select(
        "vslot", "sub", "shard", "version", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base")
    )
    within = W.partitionBy("vslot", "sub").orderBy("doc_id", "size", "text_crc32")
    numbered = sizes.withColumn("n", F.row_number().over(within) - 1)
    # n_slots * SUB_SLOTS rows at most
    return numbered.join(F.broadcast(bases), ["vslot", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("base") + F.col("n")).cast("long").alias("slot"),
        "vslot",
        F.col("version").alias("map_version"),
    )
