"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records hash into some thousands of slots; bytes are summed per slot; the map
from slot to shard has versions, and rebalancing appends a version that differs
from the last one by the slots it moves. The map is stored; a later run reads it,
edits it for the bytes that it finds and stores the new version. Only the slot
table, of a fixed size, comes to the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crucible.llm.common import stage, table

SLOTS = 4096
#: Rows of a slot are numbered in this many parts, so that a slot with most of the rows is no single task's work.
PARTS = 64


@dataclass
class SlotMap:
    """versions[v][slot] is the shard of the slot in version v."""

    shards: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def fresh(cls, slots: int, shards: int) -> SlotMap:
        return cls(shards, [[s % shards for s in range(slots)]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def rebalance(self, slot_bytes: list[int]) -> list[tuple[int, int, int]]:
        """Append a version whose shards have near-equal bytes; return the edits (slot, from, to).

        Each edit moves, from the fullest shard to the emptiest, the slot whose
        bytes are nearest to half their difference; it ends when no move makes
        the two more equal. Each makes the sum of squares of the shards' bytes
        less, so there is an end. Without edits there is no new version.
        """
        now = list(self.current)
        load = [0] * self.shards
        members: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(now):
            load[shard] += slot_bytes[slot]
            if slot_bytes[slot]:
                members[shard].add(slot)
        while True:
            hi, lo = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[hi] - load[lo]
            slot = min((s for s in members[hi] if slot_bytes[s] < gap), key=lambda s: (abs(2 * slot_bytes[s] - gap), s), default=None)
            if slot is None:
                break
            members[hi].remove(slot)
            members[lo].add(slot)
            load[hi] -= slot_bytes[slot]
            load[lo] += slot_bytes[slot]
            now[slot] = lo
        return self._append(now)

    def grow(self, slot_bytes: list[int]) -> list[tuple[int, int, int]]:
        """Append a version with one more shard, which takes slots from the fullest shards; nothing else moves."""
        now, new = list(self.current), self.shards
        load = [0] * (new + 1)
        members: list[list[int]] = [[] for _ in range(new)]
        for slot, shard in enumerate(now):
            load[shard] += slot_bytes[slot]
            members[shard].append(slot)
        for m in members:
            m.sort(key=lambda s: (slot_bytes[s], s))
        share, heap = sum(load) / (new + 1), [(-load[s], s) for s in range(new)]
        heapq.heapify(heap)
        while heap and load[new] < share:
            _, s = heapq.heappop(heap)
            slot = next((x for x in reversed(members[s]) if slot_bytes[x] and load[new] + slot_bytes[x] <= share), None)
            if slot is None:
                continue
            members[s].remove(slot)
            load[s] -= slot_bytes[slot]
            load[new] += slot_bytes[slot]
            now[slot] = new
            heapq.heappush(heap, (-load[s], s))
        self.shards = new + 1
        return self._append(now)

    def _append(self, now: list[int]) -> list[tuple[int, int, int]]:
        edits = [(slot, a, b) for slot, (a, b) in enumerate(zip(self.current, now, strict=True)) if a != b]
        if edits:
            self.versions.append(now)
        return edits

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, vslot, shard, shards): what to store. Versions times slots rows."""
        rows = [(v, s, shard, self.shards) for v, shards in enumerate(self.versions) for s, shard in enumerate(shards)]
        return spark.createDataFrame(rows, "version int, vslot int, shard int, shards int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Add a copy of the map to those under the path, numbered by its last version: earlier copies stay, so a reader always finds a whole one."""
        self.table(spark).withColumn("copy", F.lit(len(self.versions) - 1)).coalesce(1).write.mode("append").partitionBy("copy").parquet(path)

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The last map under the path; None where there is none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        copies = spark.read.parquet(path)
        last = copies.agg(F.max("copy").alias("c")).first().c
        rows = copies.filter(F.col("copy") == last).select("version", "vslot", "shard", "shards").distinct().orderBy("version", "vslot").collect()
        versions: list[list[int]] = [[] for _ in range(last + 1)]
        for r in rows:
            versions[r.version].append(r.shard)
        return cls(rows[0].shards, versions)


@dataclass
class Sharded:
    rows: DataFrame
    slot_map: SlotMap
    slot_bytes: list[int]
    stored_map: DataFrame
    edits: list[tuple[int, int, int]]
    """(slot, from, to) of the version that this run added."""


def shard_by_slots(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> Sharded:
    """Rows (id, size, text_crc32, vslot, shard, slot, map_version), the slot map and its stored table.

    The size is the text's UTF-8 bytes plus 1; a null text has none. A record's
    slot comes from its text, so equal texts share a shard; a text whose copies
    hold more than half a shard's share of all bytes or rows is spread by
    identifier. `slot` numbers the rows of a shard from 0 without gaps. Null
    identifiers, null and empty texts and repeated rows are rows like any
    other. Other columns are not read; an empty table gives no rows. docs must be
    a table scan or a staged table: rows are numbered by their place in it.

    With map_path the run begins with the map stored there, whose number of slots
    and shards then hold, or one shard more if `shards` asks for it; what it edits
    is stored there as a new version. Without, it begins with slots dealt in turn.
    """
    spark = docs.sparkSession
    slot_map = SlotMap.stored(spark, map_path) if map_path else None
    if slot_map is not None:
        slots = len(slot_map.current)
        if shards not in (slot_map.shards, slot_map.shards + 1):
            raise ValueError(f"the stored map has {slot_map.shards} shards: {shards} must be that or one more")
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + 1).alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = stage(base, "slot-rows")
    total = base.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    # Fewer than 4 * shards groups can exceed half a shard's share of bytes or of rows.
    big = base.groupBy("_h").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("b") * 2 * shards > total.b) | (F.col("n") * 2 * shards > total.n))
    hot = [r._h for r in big.filter("n > 1").select("_h").limit(4 * shards).collect()]
    spread = F.xxhash64("_h", "_id", "_row") if hot else F.col("_h")
    key = F.when(F.col("_h").isin(hot), spread).otherwise(F.col("_h")) if hot else F.col("_h")
    placed = base.withColumn("_vslot", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(slots)).cast("int")).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)).cast("int"))
    cells = stage(placed.groupBy("_vslot", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")), "slot-cells")  # slots * PARTS rows at most
    slot_bytes = [0] * slots
    for c in cells.groupBy("_vslot").agg(F.sum("b").alias("b")).collect():
        slot_bytes[c._vslot] = c.b
    edits = []
    if slot_map is None:
        slot_map = SlotMap.fresh(slots, shards)
    elif slot_map.shards + 1 == shards:
        edits += slot_map.grow(slot_bytes)
    edits += slot_map.rebalance(slot_bytes)
    if map_path:
        slot_map.store(spark, map_path)
    stored = stage(slot_map.table(spark), "slot-map")
    now = spark.createDataFrame(list(enumerate(slot_map.current)), "_vslot int, shard int")  # slots rows
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("_vslot", "_part")) - F.col("n")
    offsets = cells.join(F.broadcast(now), "_vslot").select("_vslot", "_part", "shard", begin.alias("_begin"))
    within = Window.partitionBy("_vslot", "_part").orderBy("_id", "_crc", "_row")
    rows = placed.withColumn("_n", F.row_number().over(within)).join(offsets, ["_vslot", "_part"])
    rows = rows.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_vslot").alias("vslot"), "shard",
        (F.col("_begin") + F.col("_n") - 1).alias("slot"), F.lit(len(slot_map.versions) - 1).alias("map_version"),
    )
    return Sharded(rows, slot_map, slot_bytes, stored, edits)


def op4_virtual_slots(spark, sf_dir):
    out = shard_by_slots(table(spark, sf_dir, "documents"))
    return out.rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
