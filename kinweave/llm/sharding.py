"""Sharding by fixed virtual slots.

A record hashes into one of some thousands of slots, and that never changes. A versioned map gives each slot a shard. It is
made from the bytes in each slot so that shards hold near equal bytes, and edited, slot by slot, when sizes drift or shards
are added: only the records of edited slots move.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.numbering import gapless
from kinweave.runtime import exists, spool

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """shards[slot] is the slot's shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += sizes.get(slot, 0)
        return out


def new_map(sizes: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The largest slot first, each to the shard with the least bytes, then the fewest slots, then the least number."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shards = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, n, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), n + 1, shard))
    return SlotMap(1, n_shards, tuple(shards))


def rebalanced(old: SlotMap, sizes: dict[int, int], tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the fullest shard to the emptiest while that brings a shard over the mean by more
    than `tolerance` nearer to it; all other slots stay."""
    shards, loads = list(old.shards), old.loads(sizes)
    mean = sum(loads) / old.n_shards
    own: list[list[tuple[int, int]]] = [[] for _ in loads]
    for slot, shard in enumerate(shards):
        own[shard].append((sizes.get(slot, 0), slot))
    for _ in range(len(shards)):
        high, low = max(range(len(loads)), key=loads.__getitem__), min(range(len(loads)), key=loads.__getitem__)
        room = (loads[high] - loads[low]) / 2
        fit = max((x for x in own[high] if 0 < x[0] <= room), default=None)
        if loads[high] <= mean * (1 + tolerance) or fit is None:
            break
        own[high].remove(fit)
        own[low].append(fit)
        shards[fit[1]] = low
        loads[high] -= fit[0]
        loads[low] += fit[0]
    return SlotMap(old.version + 1, old.n_shards, tuple(shards))


def grown(old: SlotMap, sizes: dict[int, int]) -> SlotMap:
    """The next version with one more shard, which takes slots from the fullest shards; no slot moves between old ones."""
    shards, loads, new = list(old.shards), [*old.loads(sizes), 0], old.n_shards
    mean = sum(loads) / len(loads)
    own: list[list[tuple[int, int]]] = [[] for _ in loads]
    for slot, shard in enumerate(shards):
        own[shard].append((sizes.get(slot, 0), slot))
    while True:
        high = max(range(new), key=loads.__getitem__)
        fit = max((x for x in own[high] if 0 < x[0] <= mean - loads[new]), default=None)
        if fit is None or loads[high] <= mean:
            return SlotMap(old.version + 1, new + 1, tuple(shards))
        own[high].remove(fit)
        shards[fit[1]] = new
        loads[high] -= fit[0]
        loads[new] += fit[0]


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write one version below `path`; a version that is there already is an error, versions never change."""
    rows = [(slot, shard) for slot, shard in enumerate(slot_map.shards)]
    table = spark.createDataFrame(rows, "slot int, shard int").select(F.lit(slot_map.n_shards).alias("n_shards"), "slot", "shard")
    table.coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """One version, or the latest."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    if not exists(spark, f"{path}/version={version}"):
        raise ValueError(f"no version {version} in {path}")
    rows = sorted(spark.read.parquet(f"{path}/version={version}").collect(), key=lambda r: r.slot)
    return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def edited(spark: SparkSession, path: str, sizes: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The latest version below `path`, edited for `sizes` and stored as the next one if any slot moves; as it is read back."""
    if not exists(spark, path):
        save_map(spark, new_map({}, n_shards, slots), path)
    old = load_map(spark, path)
    new = rebalanced(old, sizes, tolerance=0.0)
    if new.shards != old.shards:
        save_map(spark, new, path)
    return load_map(spark, path)


def slot_of(*columns: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes in each slot, at most one number a slot, from records with virtual_slot and size."""
    return {r.virtual_slot: int(r.size) for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect()}


def assign(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """`records` plus shard, by a join with the map (one small row a slot)."""
    table = records.sparkSession.createDataFrame(list(enumerate(slot_map.shards)), "virtual_slot int, shard int")
    return records.join(F.broadcast(table), "virtual_slot")


def shard_documents(docs: DataFrame, n_shards: int = 40, slot_map: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(id_col, size, *extra, virtual_slot, shard, slot) for every row of `docs`.

    size: UTF-8 bytes of the text plus 16; null counts as none. The slot comes from the id and the text together, so rows
    that repeat an id spread; rows equal in both share a slot. Groups of equal texts are dealt out by their ids, as no law of
    near equal bytes could keep a group of a third of all rows in one shard. slot numbers the rows of a shard from 0 without
    gaps. `maps` is a folder of versions: the latest one is edited for these sizes, stored as the next where slots moved, and
    read back; an empty folder begins with as many slots for each shard. Without map and folder one map is made for these
    sizes. Texts are read once and never shuffled; `extra` names columns over `docs` to carry along. Null ids and texts count;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = extra or {}
    records = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"), *[v.alias(k) for k, v in extra.items()])
    records = spool(records, "records")
    if slot_map is None:
        slot_map = edited(docs.sparkSession, maps, slot_bytes(records), n_shards, slots) if maps else new_map(slot_bytes(records), n_shards, slots)
    buckets = min(4096, max(4, records.count() // (20_000 * n_shards) + 1))
    out = gapless(assign(records, slot_map), ["shard"], [id_col, "virtual_slot"], "slot", buckets)
    return out.select(id_col, "size", *extra, "virtual_slot", "shard", "slot")
