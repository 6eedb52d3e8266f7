"""Sharding through a fixed number of virtual slots and a versioned slot map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import utf8_bytes

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard each slot is in. ``edits`` lists (slot, from, to) since the version before."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    edits: tuple[tuple[int, int, int], ...] = ()


def round_robin(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(0, shards, tuple(s % shards for s in range(slots)))


def rebalanced(now: SlotMap, slot_bytes: np.ndarray, tolerance: float = 1e-4, shards: int | None = None) -> SlotMap:
    """The next version: slots move one at a time from the fullest to the emptiest shard.

    Each move takes the slot that comes nearest to levelling the two; it stops
    when they differ by ``tolerance`` of the mean or no slot helps. With more
    ``shards`` the new ones start empty, so slots move only to where bytes are
    missing.
    """
    shards = shards or now.shards
    shard_of = np.array(now.shard_of)
    load = np.bincount(shard_of, weights=slot_bytes, minlength=shards).astype(np.int64)
    edits = []
    for _ in range(len(shard_of) * 4):
        heavy, light = int(load.argmax()), int(load.argmin())
        gap = int(load[heavy] - load[light])
        if gap <= tolerance * load.mean():
            break
        mine = np.flatnonzero((shard_of == heavy) & (slot_bytes > 0) & (slot_bytes < gap))
        if not mine.size:
            break
        slot = int(mine[np.abs(2 * slot_bytes[mine] - gap).argmin()])
        shard_of[slot] = light
        load[heavy] -= slot_bytes[slot]
        load[light] += slot_bytes[slot]
        edits.append((slot, heavy, light))
    return SlotMap(now.version + 1, shards, tuple(shard_of.tolist()), tuple(edits))


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write one version under ``path`` and the edits that made it; earlier versions stay."""
    edits = [(slot, a, b, place) for place, (slot, a, b) in enumerate(slot_map.edits)]
    spark.createDataFrame(edits, "virtual_slot int, from_shard int, to_shard int, place int").coalesce(1).write.mode("overwrite").parquet(f"{path}/edits/version={slot_map.version}")
    rows = [(slot, shard) for slot, shard in enumerate(slot_map.shard_of)]
    # the map comes last: a version that can be read is whole
    spark.createDataFrame(rows, "virtual_slot int, shard int").withColumn("shards", F.lit(slot_map.shards)).coalesce(1).write.mode("overwrite").parquet(f"{path}/maps/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``virtual_slot, shard, shards`` of a version, the newest by default: as many rows as there are slots."""
    table = spark.read.parquet(f"{path}/maps")
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).select("virtual_slot", "shard", "shards")


def load_edits(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``virtual_slot, from_shard, to_shard, place`` of the edits that made a version."""
    return spark.read.parquet(f"{path}/edits").where(F.col("version") == version).drop("version")


def newest_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest version stored under ``path``, if any."""
    try:
        version = spark.read.parquet(f"{path}/maps").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    rows = sorted(load_map(spark, path, version).collect())  # as many as there are slots
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` by built-in functions.

    A record's hash takes its doc_id and text, so neither rows without an id
    nor a doc_id of very many texts make a hot slot.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", (utf8_bytes("text") + 1).alias("size"), crc.alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot`` of every row, under the law ``bytes``.

    Records hash into ``slots`` virtual slots. Bytes per slot, a table of that
    fixed length, come to the driver. The newest map stored at ``path`` is
    loaded (version 0, stored first, deals slots round robin), edited until
    shard sizes are near equal, and stored as the next version with its edits;
    a later call with other rows, or more shards, goes on from there and moves
    only slots that it has to. What was stored is read back and joined: its
    size is bound by ``slots``. A row's place ``slot`` in its shard is its rank in the
    virtual slot plus the rows of the shard's slots before, so no task holds a
    whole shard.

    A null text has size 1; null doc_ids and repeated rows are placed like
    others, each in a place of its own; an empty table gives no rows. A text
    of any length is only hashed and measured. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots)
    slot_bytes, slot_rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        slot_bytes[r["virtual_slot"]], slot_rows[r["virtual_slot"]] = r["bytes"], r["n"]
    now = newest_map(spark, path)
    if now is None:
        now = round_robin(shards, slots)
        store_map(spark, now, path)
    if len(now.shard_of) != slots or now.shards > shards:
        raise ValueError("a stored map keeps its slots and never has fewer shards")
    second = rebalanced(now, slot_bytes, shards=shards)
    store_map(spark, second, path)
    shard_of = np.array(second.shard_of)
    before = np.zeros(slots, np.int64)
    for s in range(shards):
        mine = np.flatnonzero(shard_of == s)
        before[mine] = np.cumsum(slot_rows[mine]) - slot_rows[mine]
    offsets = spark.createDataFrame([(i, int(n)) for i, n in enumerate(before)], "virtual_slot int, rows_before long")
    newest = load_map(spark, path).drop("shards").join(F.broadcast(offsets), "virtual_slot")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(newest), "virtual_slot")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rows_before") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
