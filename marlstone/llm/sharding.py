"""Sharding over fixed virtual slots.

Records hash into thousands of slots that never change. Bytes are aggregated
per slot, and a versioned map says which shard holds which slot. Rebalancing
edits the map alone: it moves whole slots and leaves every other slot where
it was. The map has one row per slot, so its size is a parameter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, new_path
from .mixing import running

SLOTS = 4096


@dataclass
class SlotMap:
    """Slot k lies in shard ``shard[k]``; each edit makes a new version."""

    shards: int
    shard: list[int]
    version: int = 1
    log: list[str] = field(default_factory=list)

    @classmethod
    def balanced(cls, sizes: list[int], shards: int) -> SlotMap:
        """Largest slot first, each to the shard that holds least (ties: the
        lower shard)."""
        out = [0] * len(sizes)
        heap = [(0, s) for s in range(shards)]
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            held, s = heapq.heappop(heap)
            out[k] = s
            heapq.heappush(heap, (held + sizes[k], s))
        return cls(shards, out, 1, [f"balanced {len(sizes)} slots over {shards} shards"])

    def rebalanced(self, sizes: list[int], shards: int | None = None, within: float = 0.01) -> SlotMap:
        """A new version for new sizes or more shards: slots move from the
        fullest shard to the emptiest while that brings the two closer. What
        lies well stays."""
        n = shards or self.shards
        if n < self.shards:
            raise ValueError("a map can't lose shards that hold slots; build a new one")
        shard, held = list(self.shard), np.zeros(n)
        np.add.at(held, shard, sizes)
        mean, moved = sum(sizes) / n, 0
        own: list[list[int]] = [[] for _ in range(n)]
        for k, s in enumerate(shard):
            own[s].append(k)
        for _ in range(len(sizes)):
            a, b = int(held.argmax()), int(held.argmin())
            gap = held[a] - held[b]
            if gap <= within * mean:
                break
            fits = [k for k in own[a] if 0 < sizes[k] < gap]
            if not fits:
                break
            k = min(fits, key=lambda k: (abs(gap / 2 - sizes[k]), k))
            own[a].remove(k)
            own[b].append(k)
            shard[k] = b
            held[a] -= sizes[k]
            held[b] += sizes[k]
            moved += 1
        return SlotMap(n, shard, self.version + 1, [*self.log, f"version {self.version + 1}: moved {moved} slots, {n} shards"])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, k, s) for k, s in enumerate(self.shard)], "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored map; earlier versions stay."""
        self.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given or the latest version of a stored map (at most SLOTS rows)."""
        all_ = spark.read.parquet(path)
        at = version or all_.agg(F.max("version")).first()[0]
        rows = sorted((r["virtual_slot"], r["shard"]) for r in all_.where(F.col("version") == at).collect())
        return cls(max(s for _, s in rows) + 1, [s for _, s in rows], at)


def stored_map(spark: SparkSession, sizes: list[int], shards: int, path: str | None = None) -> SlotMap:
    """The map for these sizes, as read back from ``path`` (none: a new path in
    the shared folder). Version 1 is balanced and saved; where versions are
    stored, the latest is rebalanced, and saved as the next one if it moves
    slots or gets more shards."""
    path = path or new_path(spark, "slot-map")
    try:
        last = SlotMap.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        now = SlotMap.balanced(sizes, shards)
        now.save(spark, path)
    else:
        if len(last.shard) != len(sizes):
            raise ValueError(f"the stored map has {len(last.shard)} slots, not {len(sizes)}")
        now = last.rebalanced(sizes, shards)
        if now.shard == last.shard:
            now = last
        else:
            now.save(spark, path)
    return SlotMap.load(spark, path, now.version)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: 31 bits of its MD5 modulo ``slots``. A null
    key hashes as the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", slot_map: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    size: UTF-8 bytes of the text plus 1 (a null text: 1). Law ``bytes``: the
    map balances the bytes of the slots, so shards are near equal in bytes.
    slot: the row's place in its shard, gapless from 0, by virtual slot,
    identifier and checksum; rows that agree in all of these take places in any
    order. Places come from counts per virtual slot and an order by ranges that
    a repeated identifier can't widen, so no task sorts more than its range. A row without identifier hashes by its text's checksum.
    The map is stored at ``map_path`` and read back, see stored_map; a given
    ``slot_map`` is used as it is and not stored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string")))
    rows = cut(rows.withColumns({"virtual_slot": slot_of(key, slots), "tie": F.monotonically_increasing_id()}), "slots")
    held = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # at most ``slots`` rows
    map_ = slot_map or stored_map(spark, [held.get(k, (0, 0))[0] for k in range(slots)], shards, map_path)
    # a row's rank over all, less that of its virtual slot, plus the slot's place in its shard
    base, out, before = [0] * map_.shards, [], 0
    for k, s in enumerate(map_.shard):
        n = held.get(k, (0, 0))[1]
        out.append((k, s, base[s] - before))
        base[s] += n
        before += n
    places = F.broadcast(spark.createDataFrame(out, "virtual_slot int, shard int, shift long"))
    ranked = running(rows, [F.col(c) for c in ("virtual_slot", "doc_id", "text_crc32", "size", "tie")], "size", "places")
    return ranked.join(places, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def shard_pipeline(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """docs with shard and virtual_slot of every row added (columns of these
    names that docs already has are replaced). Sizes from the text itself; the
    map is stored as in shard_documents."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "virtual_slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.crc32(text.cast("binary")).cast("string")))
    keyed = docs.withColumn("virtual_slot", slot_of(key, slots))
    held = {r["virtual_slot"]: r["bytes"] for r in keyed.groupBy("virtual_slot").agg(F.sum(F.octet_length(text).cast("long") + 1).alias("bytes")).collect()}  # at most ``slots`` rows
    map_ = stored_map(spark, [held.get(k, 0) for k in range(slots)], shards, map_path)
    return keyed.join(F.broadcast(map_.table(spark).select("virtual_slot", "shard")), "virtual_slot").select(*docs.columns, "shard", "virtual_slot")


ORACLE = f"""
with recursive crc(k, i, v) as (
  select k, 0, k from range(256) t(k)
  union all
  select k, i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc where i < 8),
crcs as (select list(v order by k) as t from crc where i = 8),
d as (
  select doc_id,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
             lambda a, b: xor(a >> 8, crcs.t[xor(a & 255, b) + 1])), 4294967295)::bigint as text_crc32, coalesce(octet_length(encode(text)), 0) + 1 as size,
         (('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % {SLOTS})::int as virtual_slot
  from documents, crcs),
s as (select virtual_slot, sum(size)::bigint as bytes, count(*) as n from d group by 1),
o as (select *, row_number() over (order by bytes desc, virtual_slot) as i from s),
lpt(i, held, shard) as (
  select 0::bigint, [0::bigint for x in range(16)], null::int
  union all
  select l.i + 1, [case when k = list_position(l.held, list_min(l.held)) then l.held[k] + o.bytes else l.held[k] end for k in range(1, 17)],
         (list_position(l.held, list_min(l.held)) - 1)::int
  from lpt l join o on o.i = l.i + 1),
m as (select o.virtual_slot, lpt.shard, o.n from lpt join o using (i)),
b as (select *, (sum(n) over (partition by shard order by virtual_slot) - n)::bigint as base from m)
select d.doc_id, d.size::bigint as size, d.text_crc32, 'bytes' as law, b.shard,
       (b.base + row_number() over (partition by d.virtual_slot order by d.doc_id) - 1)::bigint as slot,
       null::int as grown_shard, d.virtual_slot
from d join b using (virtual_slot)
"""
