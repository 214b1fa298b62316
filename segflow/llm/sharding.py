"""Dealing records to shards through fixed virtual slots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segflow.llm.shared import cut

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``size`` (UTF-8 bytes of the text, a null text has none, plus 1) and ``text_crc32``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("text_crc32", F.crc32(text.cast("binary")))


def with_slots(rows: DataFrame, by: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot``: a hash of the columns ``by``."""
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int"))


def slot_totals(slotted: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): at most as many rows as there are slots."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map: equal runs of slots."""
    return spark.createDataFrame([(1, s, s * shards // slots) for s in range(slots)], MAP_SCHEMA)


def latest(slot_map: DataFrame) -> DataFrame:
    """The newest version in a map that may hold several."""
    newest = slot_map.agg(F.max("version").alias("version"))
    return slot_map.join(F.broadcast(newest), "version")


def moves(weights: np.ndarray, shard_of: np.ndarray, shards: int, tolerance: float) -> np.ndarray:
    """Move slots, or swap two, from the heaviest shard to the lightest until their loads differ by ``tolerance`` of the mean or nothing helps."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights, shards)
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        if gap <= tolerance * load.mean():
            return shard_of
        give, take = np.flatnonzero((shard_of == high) & (weights > 0)), np.flatnonzero(shard_of == low)
        take = take[np.argsort(weights[take], kind="stable")]
        back = np.concatenate([[0.0], weights[take]])
        wanted = weights[give] - gap / 2
        at = np.clip(np.searchsorted(back, wanted), 0, len(back) - 1)
        at = np.where((at > 0) & (np.abs(back[at - 1] - wanted) < np.abs(back[at] - wanted)), at - 1, at)
        change = weights[give] - back[at]
        best = int(np.argmin(np.abs(change - gap / 2))) if len(give) else 0
        if not len(give) or not 0 < change[best] < gap:
            return shard_of
        shard_of[give[best]] = low
        if at[best]:
            shard_of[take[at[best] - 1]] = high
        load[high] -= change[best]
        load[low] += change[best]


def rebalance(slot_map: DataFrame, totals: DataFrame, shards: int, weight: str = "bytes", tolerance: float = 0.001) -> DataFrame:
    """The next version of the map, edited so that shards hold nearly equal ``weight``; other slots stay where they are.

    The driver sees one number for each slot, whatever the input's size.
    """
    spark, old = slot_map.sparkSession, latest(slot_map).collect()
    slots = 1 + max(r["virtual_slot"] for r in old)
    shard_of, weights = np.zeros(slots, np.int64), np.zeros(slots)
    for r in old:
        shard_of[r["virtual_slot"]] = r["shard"]
    for r in totals.select("virtual_slot", F.col(weight).alias("w")).collect():
        weights[r["virtual_slot"]] = r["w"]
    edited = moves(weights, shard_of, shards, tolerance)
    return spark.createDataFrame([(old[0]["version"] + 1, s, int(x)) for s, x in enumerate(edited)], MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add the map's versions to the table of maps at ``path``."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default."""
    stored = spark.read.parquet(path).select("version", "virtual_slot", "shard")
    return latest(stored) if version is None else stored.where(F.col("version") == version)


def deal(slotted: DataFrame, totals: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Add ``shard`` and the row's gapless position ``slot`` in it.

    Rows are numbered inside their virtual slot, so a shard is never one task;
    a slot's first number follows from the totals (one row for each slot).
    """
    placed = latest(slot_map).select("virtual_slot", "shard").join(totals, "virtual_slot")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    firsts = placed.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    found = slotted.withColumn("__inside", inside).join(F.broadcast(firsts), "virtual_slot")
    return found.withColumn("slot", F.col("__first") + F.col("__inside")).drop("__first", "__inside")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes.

    Rows are hashed by id and text into ``slots`` virtual slots; bytes are
    summed for each slot; the slot-to-shard map (version 1: equal runs of
    slots, or the newest version stored at ``map_path``) is edited to even out
    the bytes, and stored there again if a path is given.

    Returns ``id_col, size, text_crc32, law ('bytes'), virtual_slot, shard,
    slot``. A null text has no bytes; null ids are hashed with their texts;
    repeated rows share a virtual slot; an empty table gives none. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    slotted = with_slots(sized(docs.select(id_col, text_col), text_col), [id_col, text_col], slots).drop(text_col)
    totals = cut(slot_totals(slotted))
    old = first_map(spark, shards, slots)
    if map_path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(map_path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            old = load_map(spark, map_path)
        else:
            save_map(old, map_path)
    new = rebalance(old, totals, shards)
    if map_path is not None:
        save_map(new, map_path)
    dealt = deal(slotted, totals, new, [id_col, "text_crc32", "size"])
    return dealt.withColumn("law", F.lit("bytes")).select(id_col, "size", "text_crc32", "law", "virtual_slot", "shard", "slot")
