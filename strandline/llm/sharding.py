"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots, the bytes of each slot are summed, and a small versioned map, kept in a
folder, says which shard owns which slot. Growing or rebalancing edits the map only; no record is ever hashed anew.
"""

from __future__ import annotations

import bisect
import heapq
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import scratch_path

#: Virtual slots; fixed for the life of a data set, and the bound of everything that the driver holds.
SLOTS = 8192
#: Bytes that each record counts besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each slot, and how it came about."""

    shards: int
    owner: tuple[int, ...]
    version: int = 1
    log: tuple[str, ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "owner": list(self.owner), "log": list(self.log)})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        x = json.loads(text)
        return SlotMap(x["shards"], tuple(x["owner"]), x["version"], tuple(x["log"]))

    def save(self, spark: SparkSession, folder: str) -> str:
        """Add this version to a folder in any store that Spark writes; earlier versions stay."""
        path = f"{folder.rstrip('/')}/slot-map-v{self.version:06d}"
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The newest version kept in ``folder``, or the one asked for."""
        rows = spark.read.text(f"{folder.rstrip('/')}/slot-map-v*").collect()
        maps = {m.version: m for m in (SlotMap.from_json(r.value) for r in rows)}
        return maps[max(maps) if version is None else version]

    def loads(self, slot_bytes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += slot_bytes.get(slot, 0)
        return out

    def rebalance(self, slot_bytes: dict[int, int]) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard, or change places between them, while that
        narrows their gap; the rest stays where it is."""
        owner, loads = list(self.owner), self.loads(slot_bytes)
        of: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            if slot_bytes.get(slot, 0):
                bisect.insort(of[shard], (slot_bytes[slot], slot))
        moved = 0
        while self.shards > 1:
            full, low = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap, best = loads[full] - loads[low], None
            for give in of[full]:
                # in return nothing, or the slot that brings both nearest to their mean
                at = bisect.bisect_left(of[low], (give[0] - gap / 2, -1))
                for back in (None, *of[low][max(at - 1, 0) : at + 1]):
                    less = give[0] - (back[0] if back else 0)
                    if 0 < less < gap and (best is None or abs(2 * less - gap) < best[0]):
                        best = (abs(2 * less - gap), less, give, back)
            if best is None:
                break
            _, less, give, back = best
            for slot, source, target in ((give, full, low), (back, low, full)):
                if slot:
                    of[source].remove(slot)
                    bisect.insort(of[target], slot)
                    owner[slot[1]] = target
                    moved += 1
            loads[full] -= less
            loads[low] += less
        return SlotMap(self.shards, tuple(owner), self.version + 1, (*self.log, f"rebalance: {moved} slots moved"))

    def grow(self, slot_bytes: dict[int, int]) -> SlotMap:
        """Add one shard and move slots into it alone, from the fullest shards, up to the new mean."""
        owner, loads = list(self.owner), [*self.loads(slot_bytes), 0]
        mean, moved = sum(loads) / len(loads), 0
        heaps = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            heapq.heappush(heaps[shard], (slot_bytes.get(slot, 0), slot))
        while True:
            giver = max(range(self.shards), key=lambda s: (loads[s], -s))
            while heaps[giver] and heaps[giver][0][0] == 0:
                heapq.heappop(heaps[giver])
            if not heaps[giver] or loads[-1] + heaps[giver][0][0] > mean:
                break
            size, slot = heapq.heappop(heaps[giver])
            owner[slot] = self.shards
            loads[giver] -= size
            loads[-1] += size
            moved += 1
        return SlotMap(self.shards + 1, tuple(owner), self.version + 1, (*self.log, f"grow to {self.shards + 1}: {moved} slots moved"))


def dealt_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """The first version for a new data set: slots are dealt in turn."""
    return SlotMap(shards, tuple(s % shards for s in range(slots)), 1, (f"dealt over {shards} shards",))


def balanced_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """A first version made from known bytes: the largest slot first, always to the shard with the fewest bytes."""
    owner, heap = [s % shards for s in range(slots)], [(0, k) for k in range(shards)]
    for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return SlotMap(shards, tuple(owner), 0, (f"balanced over {shards} shards",)).rebalance(slot_bytes)


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row: the slot is a hash of the id, or of the text of a null id.

    A null text has size 16 and the checksum of no bytes; equal rows share a slot; other columns are not carried.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.when(F.col(id_col).isNull(), crc))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_stats(rows: DataFrame) -> DataFrame:
    """Bytes and records by virtual slot; at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def place(rows: DataFrame, slot_map: SlotMap, stats: dict[int, tuple[int, int]]) -> DataFrame:
    """Shard of each row, and its place in that shard: gapless from 0, by slot, then by id, checksum and size.

    ``stats`` has the bytes and rows of every slot that ``rows`` fill. Only ids and numbers are sorted within a slot, never
    texts.
    """
    spark, next_place, table = rows.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.owner):
        if slot in stats:
            table.append((slot, shard, next_place[shard]))
            next_place[shard] += stats[slot][1]
    owners = spark.createDataFrame(table, "virtual_slot int, shard int, before long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(owners), "virtual_slot").withColumn("slot", F.col("before") + F.row_number().over(within) - 1).drop("before")


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Deal ``df`` over ``shards`` so that their bytes are near equal (the law ``bytes``).

    The newest map in ``folder`` is loaded, or a first one is dealt and kept there; it is edited by the slots' bytes, the
    edited version is kept beside it, and rows are placed by what is then read back. Without a folder, one in the shared
    folder is used. Returns one row per input row (doc_id, size, text_crc32, virtual_slot, shard, slot) and that version.

    A null text has size 16 and the checksum of no bytes; a null id is placed by its text; repeated rows each
    get a place of their own; an empty table gives an empty result. Other columns are not carried. Equal texts are a
    group for nobody's placement: their ids spread them over the shards, as a group of a third of all rows could not
    stay in one shard of near equal bytes. The map has at most ``slots`` entries, which bounds what is collected and
    broadcast whatever the table's size.
    """
    if shards < 1 or slots < shards:
        raise ValueError("there must be a shard, and a slot for each shard")
    spark = df.sparkSession
    rows = sized(df, id_col, text_col, slots)
    stats = {r.virtual_slot: (r.slot_bytes, r.slot_rows) for r in slot_stats(rows).collect()}
    folder = folder or scratch_path(spark, "slot-map")
    try:
        known = SlotMap.load(spark, folder)
    except AnalysisException:  # no map is kept there yet
        dealt_map(shards, slots).save(spark, folder)
        known = SlotMap.load(spark, folder)
    if (known.shards, len(known.owner)) != (shards, slots):
        raise ValueError(f"the map in {folder} is of {known.shards} shards and {len(known.owner)} slots")
    known.rebalance({k: v[0] for k, v in stats.items()}).save(spark, folder)
    slot_map = SlotMap.load(spark, folder, known.version + 1)
    return place(rows, slot_map, stats), slot_map
