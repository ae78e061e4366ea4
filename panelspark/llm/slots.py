"""Sharding by fixed virtual slots (DataFrame operations only).

Every record hashes into one of ``N_SLOTS`` slots; the slot count never changes.  Bytes are summed
per slot, and a versioned map places whole slots on shards: the heaviest slot first, each on the
shard with the fewest bytes so far.  Rebalancing edits the map: slots move from shards above the
mean to shards below it (or to new, empty shards), all other slots stay, and the version goes up
by one.  Records are never hashed anew, so an edit moves the records of edited slots only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from panelspark.llm.scratch import stored

N_SLOTS = 16384
RECORD_BYTES = 16                # size of a record besides its text


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot.  The slot follows from the id and the text's checksum, so
    copies of one text spread over all slots, and so do records without an id."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), crc.alias("text_crc32"))
            .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int")))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """vslot, bytes, n: at most one row per slot."""
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def build_map(slots: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """The first map: (version, vslot, shard), greedy by bytes, over the slots in use.

    One row per slot: the fold below walks an array of at most N_SLOTS entries."""
    ordered = F.expr("array_sort(collect_list(struct(-bytes as b, vslot)))")
    loads = f"cast(array_repeat(0L, {n_shards}) as array<bigint>)"
    fold = F.expr(f"""aggregate(s, named_struct('load', {loads}, 'at', cast(array() as array<int>)),
        (acc, x) -> named_struct(
            'load', transform(acc.load, (l, i) -> if(i = array_position(acc.load, array_min(acc.load)) - 1, l - x.b, l)),
            'at', acc.at || array(cast(array_position(acc.load, array_min(acc.load)) - 1 as int))),
        acc -> arrays_zip(transform(s, x -> x.vslot), acc.at))""")
    return (slots.agg(ordered.alias("s")).select(F.explode(fold).alias("e"))
            .select(F.lit(version).alias("version"), F.col("e")["0"].alias("vslot"), F.col("e")["at"].alias("shard")))


def rebalance(old: DataFrame, slots: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for ``n_shards`` >= the old count.

    Every old shard above the mean gives up its lightest slots until it is at the mean or under, or holds its heaviest slot
    only (a slot heavier than the mean stays where it is); the freed slots go, heaviest first, each to the shard with
    the fewest bytes.  Slots not yet in the map are placed likewise; no other slot moves.  An empty ``old`` places every
    slot, as version 1; without slots the new version has no rows; slots of ``old`` that hold no bytes any more are left out."""
    known = slots.join(F.broadcast(old), "vslot", "left")          # at most N_SLOTS rows
    mean = known.agg((F.sum("bytes") / F.lit(n_shards)).alias("mean"))
    by_weight = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    held = known.join(F.broadcast(mean)).withColumn("before", F.coalesce(F.sum("bytes").over(by_weight.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    stays = held.withColumn("keep", F.col("shard").isNotNull() & ((F.col("before") <= F.col("mean")) | (F.col("before") == F.col("bytes"))))
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast(old.schema["version"].dataType).alias("version"))
    every = F.sequence(F.lit(0), F.lit(n_shards - 1))
    loads = (stays.where("keep").groupBy("shard").agg(F.sum("bytes").alias("b"))
             .agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))
             .select(F.transform(every, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("load")))
    free = stays.where("not keep").agg(F.expr("array_sort(collect_list(struct(-bytes as b, vslot)))").alias("s"))
    fold = F.expr("""aggregate(s, named_struct('load', load, 'at', cast(array() as array<int>)),
        (acc, x) -> named_struct(
            'load', transform(acc.load, (l, i) -> if(i = array_position(acc.load, array_min(acc.load)) - 1, l - x.b, l)),
            'at', acc.at || array(cast(array_position(acc.load, array_min(acc.load)) - 1 as int))),
        acc -> arrays_zip(transform(s, x -> x.vslot), acc.at))""")
    moved = (free.join(F.broadcast(loads)).select(F.explode(fold).alias("e"))
             .select(F.col("e")["0"].alias("vslot"), F.col("e")["at"].alias("shard")))
    now = stays.where("keep").select("vslot", "shard").union(moved)
    return now.join(F.broadcast(version)).select("version", "vslot", "shard")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Store a map under its version; older versions stay readable.  A map without rows stores nothing."""
    slot_map.write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark, folder: str, version: int | None = None) -> DataFrame:
    """A stored map, the latest by default; without rows where no such version was stored."""
    maps = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    latest = maps.agg(F.max("version").alias("version")) if version is None else None
    got = maps.where(F.col("version") == version) if latest is None else maps.join(F.broadcast(latest), "version", "left_semi")
    return got.select("version", "vslot", "shard")


def assign(recs: DataFrame, slots: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard, and its place in the shard: gapless from 0, ordered by slot, id, checksum, size.

    The place is the records in earlier slots of the shard plus the place in the own slot, so no
    shard is ever sorted in one task."""
    w = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (slots.join(F.broadcast(slot_map), "vslot")
              .withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))).select("vslot", "shard", "start", "version"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (recs.withColumn("r", place).join(F.broadcast(starts), "vslot")      # at most N_SLOTS rows
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version")))


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS) -> DataFrame:
    """Every row of ``docs`` with its shard under the law ``bytes`` (shard sizes near equal).

    Defined results: a NULL text counts as empty (size 16, checksum 0); a NULL doc_id is hashed by
    its text alone; repeated rows are records of their own in one slot, each with its own place;
    an empty table gives an empty result.  Other columns are ignored."""
    recs = stored(records(docs, n_slots), "records")
    slots = stored(slot_bytes(recs), "slots")
    return assign(recs, slots, stored(build_map(slots, n_shards), "slot-map"))
