"""Shards over fixed virtual slots.

Records are hashed into thousands of virtual slots that never change. Only the bytes of each slot are
gathered; a slot-to-shard map, a table of as many rows as there are slots, says which shard holds which
slots. The map has a version: rebalancing edits it, and a record moves only if its slot does."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm._common import shared_dir, table, written

VIRTUAL_SLOTS = 16_384


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the slot's shard. Bounded: one entry a virtual slot."""

    shard_of: tuple
    shards: int
    version: int = 1

    @staticmethod
    def balanced(weights: np.ndarray, shards: int) -> SlotMap:
        """Heaviest slot first into the lightest shard."""
        heap, to = [(0, s) for s in range(shards)], np.zeros(len(weights), int)
        for slot in np.lexsort((np.arange(len(weights)), -weights)):
            load, s = heapq.heappop(heap)
            to[slot] = s
            heapq.heappush(heap, (load + int(weights[slot]), s))
        return SlotMap(tuple(map(int, to)), shards)

    def rebalanced(self, weights: np.ndarray, shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version: slots, heaviest first, go from heavy shards to those (also new ones) that are
        under the mean now; no other slot moves. Fewer shards: the slots of the dropped ones are dealt again."""
        shards = shards or self.shards
        to = np.array(self.shard_of)
        order = np.lexsort((np.arange(len(weights)), -weights))
        load = np.bincount(to[to < shards], weights=weights[to < shards], minlength=shards)
        for slot in order[to[order] >= shards]:
            to[slot] = int(load.argmin())
            load[to[slot]] += weights[slot]
        mean = load.sum() / shards
        under = np.flatnonzero(load < mean * (1 - tolerance))
        for slot in order if len(under) else ():
            s, w = to[slot], weights[slot]
            light = int(under[load[under].argmin()])
            if s not in under and load[s] - w >= mean * (1 - tolerance) and load[light] + w <= mean * (1 + tolerance):
                to[slot] = light
                load[s] -= w
                load[light] += w
        return replace(self, shard_of=tuple(map(int, to)), shards=shards, version=self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "vslot int, shard int")

    def store(self, spark: SparkSession, path: str) -> str:
        """Write this version beside the earlier ones."""
        at = f"{path}/version={self.version:06d}"
        self.frame(spark).coalesce(1).withColumn("shards", F.lit(self.shards)).write.mode("overwrite").parquet(at)
        return at

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the last one."""
        if version is None:
            version = spark.read.parquet(path).agg(F.max("version")).first()[0]
        rows = spark.read.parquet(f"{path}/version={version:06d}").orderBy("vslot").collect()
        return SlotMap(tuple(r["shard"] for r in rows), rows[0]["shards"], version)


def slotted(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 and vslot of every row; null texts have no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return d.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = VIRTUAL_SLOTS) -> np.ndarray:
    """Bytes of each slot on the driver: at most `slots` numbers, whatever the input."""
    got = np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("n")).collect():
        got[r["vslot"]] = r["n"]
    return got


def sharded(docs: DataFrame, shards: int, slots: int = VIRTUAL_SLOTS, slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """Every row with its vslot, shard and slot: its place in the shard, gapless from 0.

    Without a map one is balanced by bytes. Places are counted over virtual slots first, so no task
    ranks a whole shard. Repeated rows take places of their own; no rows give no rows."""
    rows = written(slotted(docs, slots), "slotted")
    if slot_map is None:
        slot_map = SlotMap.balanced(slot_bytes(rows, slots), shards)
    if store:
        slot_map.store(docs.sparkSession, store)
    where = slot_map.frame(docs.sparkSession)
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(where), "vslot")
    ahead = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("vslot", "shard", "first")
    here = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    rows = rows.join(F.broadcast(counts), "vslot")  # one row a virtual slot
    return rows.withColumn("slot", F.col("first") + F.row_number().over(here) - 1).drop("first")


def resharded(docs: DataFrame, path: str, shards: int | None = None) -> tuple[DataFrame, SlotMap]:
    """The rows by the next version of a stored map, which is edited for the slots' bytes now (and another number of
    shards) and stored beside the others, and that version."""
    spark = docs.sparkSession
    last = SlotMap.load(spark, path)
    now = last.rebalanced(slot_bytes(slotted(docs, len(last.shard_of)), len(last.shard_of)), shards)
    return sharded(docs, now.shards, len(now.shard_of), now, path), now


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes, by the slot-to-shard map that map_path names, version 1."""
    path = f"{shared_dir(spark)}/slot_map"
    got = sharded(table(spark, sf_dir, "documents"), 40, store=path)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(path).alias("map_path"), F.lit(1).alias("map_version"))
