"""Sharding by fixed virtual slots.

Records are hashed into SLOTS slots, whose number never changes. Bytes and records are
summed by slot, and a small map says which shard a slot belongs to. The map is kept in
versions: it begins as slot modulo shards, and rebalancing publishes an edited version
that moves as few slots as evening the shards' bytes takes. Readers name a version, so
that a map that is being edited never mixes with the one in use.

The map has one row a slot (and one for each part of a hot slot), whatever the size of
the table, and is therefore all that reaches the driver or is broadcast.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import PLACE, cut, located, scratch, table

SHARDS = 24
#: Virtual slots: thousands, so that one is a small part of a shard; fixed for the life of a map.
SLOTS = 8192
#: A slot of more bytes than 1 / HOT of a shard's fair share is hot, and is dealt to PARTS parts by its records' places.
HOT = 16
PARTS = 256
#: Bytes that a record takes beside its text.
OVERHEAD = 8
MAP = "slot int, part int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each (slot, part) belongs to. Part 0 stands for a whole slot; hot slots have PARTS parts."""

    version: int
    shards: int
    shard: dict[tuple[int, int], int]

    def hot(self) -> list[int]:
        return sorted({slot for slot, part in self.shard if part})


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1, before anything is known of the records: slot modulo shards."""
    return SlotMap(1, shards, {(s, 0): s % shards for s in range(slots)})


def split(old: SlotMap, hot: list[int], parts: int = PARTS) -> SlotMap:
    """An edit that gives the hot slots parts of their own; each part stays where its slot was."""
    shard = dict(old.shard)
    for slot in hot:
        shard |= {(slot, part): old.shard[slot, 0] for part in range(parts)}
    return SlotMap(old.version + bool(hot), old.shards, shard)


def rebalance(old: SlotMap, size: dict[tuple[int, int], int]) -> SlotMap:
    """An edit that evens the shards' bytes: slots go from the fullest shard to the emptiest while that narrows the gap.

    The slot that comes nearest to half the gap goes each time, so few moves do it. It
    ends when no slot of the fullest shard is smaller than its gap to the emptiest.
    """
    shard = dict(old.shard)
    total = [0] * old.shards
    own: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in total]
    for key, s in shard.items():
        if size.get(key):
            total[s] += size[key]
            insort(own[s], (size[key], key))
    full, poor = [(-t, s) for s, t in enumerate(total)], [(t, s) for s, t in enumerate(total)]
    heapq.heapify(full)
    heapq.heapify(poor)

    def top(heap: list, sign: int) -> int:
        while heap[0][0] != sign * total[heap[0][1]]:  # left behind by a move
            heapq.heappop(heap)
        return heap[0][1]

    while True:
        a, b = top(full, -1), top(poor, 1)
        gap = total[a] - total[b]
        at = bisect_right(own[a], (gap // 2, (1 << 31, 0)))
        at = at - 1 if at else 0
        if gap < 2 or not own[a] or own[a][at][0] >= gap:
            break
        n, key = own[a].pop(at)
        insort(own[b], (n, key))
        shard[key] = b
        for s, change in ((a, -n), (b, n)):
            total[s] += change
            heapq.heappush(full, (-total[s], s))
            heapq.heappush(poor, (total[s], s))
    return SlotMap(old.version + (shard != old.shard), old.shards, shard)


def grow(old: SlotMap, size: dict[tuple[int, int], int]) -> SlotMap:
    """An edit with one more shard: slots move into the new one alone, until it has its fair share of the bytes.

    They come from the shards that have most, largest slots first that still fit.
    """
    new, shard = old.shards, dict(old.shard)
    fair = sum(size.values()) // (new + 1)
    total = [0] * (new + 1)
    own: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(new)]
    for key, s in shard.items():
        total[s] += size.get(key, 0)
        insort(own[s], (size.get(key, 0), key))
    heap = [(-t, s) for s, t in enumerate(total[:new])]
    heapq.heapify(heap)
    while heap and total[new] < fair:
        _, s = heapq.heappop(heap)
        room = min(fair - total[new], total[s] - fair)
        at = bisect_right(own[s], (room, (1 << 31, 0)))
        if not at or not own[s][at - 1][0]:
            continue  # nothing of this shard fits
        n, key = own[s].pop(at - 1)
        shard[key] = new
        total[s] -= n
        total[new] += n
        heapq.heappush(heap, (-total[s], s))
    return SlotMap(old.version + 1, new + 1, shard)


def publish(spark: SparkSession, folder: str, new: SlotMap) -> str:
    """Store a version below ``folder``. It is written beside and then renamed, so that it is there whole or not at all.

    A version that exists is never overwritten: two writers that edit the same version can't both succeed.
    """
    path, unnamed = f"{folder}/version={new.version}", scratch(spark, "slot-map")
    rows = [(slot, part, s) for (slot, part), s in sorted(new.shard.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).withColumn("shards", F.lit(new.shards)).write.parquet(unnamed)
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, there = hadoop.Path(unnamed), hadoop.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(there.getParent())
    if store.exists(there) or not store.rename(here, there):
        store.delete(here, True)
        raise FileExistsError(f"version {new.version} of the slot map is there already")
    return path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions published below ``folder``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """A version of the map, by default the latest."""
    number = version if version is not None else max(versions(spark, folder))
    rows = spark.read.schema(f"{MAP}, shards int").parquet(f"{folder}/version={number}").collect()
    return SlotMap(number, rows[0].shards, {(r.slot, r.part): r.shard for r in rows})


def slot_of(*columns: str, slots: int = SLOTS) -> Column:
    """A record's virtual slot: a hash of what it holds."""
    return F.pmod(F.xxhash64(*(F.col(c) for c in columns)), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """One row a record: id long, size, text_crc32 long, slot, part int, PLACE. Texts are read here once.

    A null text has no bytes. Rows that are alike in identifier and text have one slot;
    ``part``, by the record's place, is what deals them out if that slot is hot.
    """
    rows = located(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    return rows.select(
        "id",
        (F.octet_length("text") + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        slot_of("id", "text", slots=slots).alias("slot"),
        F.pmod(F.xxhash64(*PLACE), F.lit(parts)).cast("int").alias("part"),
        *PLACE,
    )


def slot_sizes(rows: DataFrame, hot: list[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """(slot, part) -> (bytes, records); parts of the hot slots, 0 for the others. At most a row a slot and a hot slot's part."""
    summed = rows.groupBy("slot", _part(hot).alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    return {(r.slot, r.part): (r.bytes, r.records) for r in summed.collect()}


def _part(hot: list[int]) -> Column:
    return F.when(F.col("slot").isin(hot), F.col("part")).otherwise(0) if hot else F.lit(0)


def balanced(spark: SparkSession, rows: DataFrame, shards: int, folder: str, slots: int = SLOTS, hot: int = HOT, parts: int = PARTS) -> tuple[SlotMap, dict[tuple[int, int], tuple[int, int]]]:
    """The latest map below ``folder`` edited for these records (version 1 where there is none), and what its slots hold.

    Slots found hot keep their parts in later versions. Every version on the way is published.
    """
    known = versions(spark, folder)
    now = load(spark, folder) if known else first_map(shards, slots)
    if not known:
        publish(spark, folder, now)
    held = slot_sizes(rows, now.hot())
    fair = sum(b for b, _ in held.values()) / now.shards
    large = [slot for (slot, part), (b, n) in held.items() if not part and n > 1 and b * hot > fair and slot not in now.hot()]
    if large:
        now = split(now, sorted(large), parts)
        publish(spark, folder, now)
        held = slot_sizes(rows, now.hot())
    new = rebalance(now, {k: b for k, (b, _) in held.items()})
    if new.version != now.version:
        publish(spark, folder, new)
    return new, held


def place_in_shards(rows: DataFrame, slot_map: SlotMap, held: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """rows with shard int and place long, a number from 0 in the shard without a gap: by slot, then identifier and place.

    Records are numbered within their slots (or parts of hot ones), thousands of small
    windows, and begin where the shard's earlier slots end; no task holds a shard.
    """
    spark = rows.sparkSession
    begin, at = [], [0] * slot_map.shards
    for key, s in sorted(slot_map.shard.items()):
        if key in held:
            begin.append((*key, s, at[s]))
            at[s] += held[key][1]
    mapped = F.broadcast(spark.createDataFrame(begin, "slot int, part int, shard int, begin long"))  # a row a slot or part
    inside = W.partitionBy("slot", "part").orderBy(F.col("id").asc_nulls_last(), *PLACE)
    dealt = rows.withColumn("part", _part(slot_map.hot())).withColumn("place", F.row_number().over(inside).cast("long") - 1)
    return dealt.join(mapped, ["slot", "part"]).withColumn("place", F.col("begin") + F.col("place")).drop("begin")


def assign(docs: DataFrame, shards: int = SHARDS, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row a record: id_col, size, text_crc32, virtual_slot, shard, place, map_version.

    ``folder`` holds the versions of the slot map (a new one below the shared folder by
    default): a later call with other records goes on from the latest and moves as little
    as it needs. Shards have nearly equal bytes unless single records are larger than
    that. Null identifiers and texts are values like others; rows repeated in full are
    records each, and a hot slot, of a third of all records for instance, is dealt out in
    parts; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = cut(records(docs, id_col, text_col, slots))
    new, held = balanced(spark, rows, shards, folder or scratch(spark, "slots"), slots)
    placed = place_in_shards(rows, new, held)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard", "place", F.lit(new.version).alias("map_version"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, size, text_crc32 long, law string, shard int, slot long, grown_shard int, virtual_slot, map_version int.

    The law is `bytes`: the slot map is edited until the shards' bytes are even. ``slot``
    is the document's number in its shard, from 0; ``grown_shard`` is null under this law.
    """
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
