"""Sharding over fixed virtual slots.

A record's slot comes from a hash of its text and never changes. Bytes are
summed per slot, and a small versioned map, stored as a table, says which shard
owns each slot; rebalancing and growing write its next version and move only
the slots they must. Equal texts share a slot and so a shard: every group of
equal texts that fits into a shard's fair share stays whole, and so do all
other texts of its slot. Only a text whose copies outweigh a share is cut, by
the records' ids, into sub-slots of its own, as there equal bytes and whole
groups cannot both hold; there are fewer such texts than shards. Only the slot table,
bounded by `SLOTS` plus `SALTS` rows a cut text, ever reaches the driver.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, written

SLOTS = 4096
#: Parts of each slot by id: its records are numbered part by part, so no task holds a whole slot; a cut text's parts are its sub-slots.
SALTS = 16
MAP = "version int, vslot int, cut long, salt int, shard int"
#: What a map owns: a slot, the hash of a cut text (0: all other texts of the slot), and its sub-slot (0 for those).
Key = tuple[int, int, int]


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, hash, salt) of each record; size is the text's UTF-8 bytes plus 1, a null text has none."""
    told = F.coalesce(docs[text], F.lit(""))
    by = F.when(docs[doc_id].isNull(), F.xxhash64(F.lit(12), F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit(11), docs[doc_id]))
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        (F.octet_length(told) + 1).cast("long").alias("size"),
        F.crc32(told.cast("binary")).alias("text_crc32"),
        F.xxhash64(told).alias("hash"),
        F.pmod(by, F.lit(SALTS)).cast("int").alias("salt"),
    )
    return rows.withColumn("vslot", F.pmod("hash", F.lit(SLOTS)).cast("int")).withColumn("hash", F.when(F.col("hash") == 0, 1).otherwise(F.col("hash")))


def plan(weights: dict[Key, int], shards: int) -> dict[Key, int]:
    """Version 1 of the map: the heaviest key first, into the lightest shard."""
    return extended({}, weights, shards)


def rebalanced(owner: dict[Key, int], weights: dict[Key, int], shards: int) -> dict[Key, int]:
    """The next version of the map for `shards` shards: new shards take slots of the fullest ones until they have their share, nothing else moves."""
    out = dict(owner)
    load, held = {s: 0 for s in range(shards)}, {s: [] for s in range(shards)}
    for key, s in sorted(out.items()):
        load[s] += weights.get(key, 0)
        held[s].append((weights.get(key, 0), key))
    for keys in held.values():
        keys.sort()
    fair = sum(load.values()) / shards
    for new in sorted(set(range(shards)) - set(owner.values())):
        while True:
            old = max((s for s in load if s != new), key=lambda s: (load[s], -s))
            room = min(load[old] - fair, fair - load[new])
            at = bisect.bisect_right(held[old], (room, (SLOTS,))) - 1  # the heaviest slot that leaves neither beyond its share
            if at < 0:
                break
            w, key = held[old].pop(at)
            out[key] = new
            load[old], load[new] = load[old] - w, load[new] + w
    return out


def extended(owner: dict[Key, int], weights: dict[Key, int], shards: int) -> dict[Key, int]:
    """The map with owners for the keys it lacks, heaviest first into the lightest shard. Nothing moves."""
    out, load = dict(owner), dict.fromkeys(range(shards), 0)
    for key, s in owner.items():
        load[s] += weights.get(key, 0)
    heap = sorted((w, s) for s, w in load.items())
    for key in sorted(weights.keys() - owner.keys(), key=lambda k: (-weights[k], k)):
        w, s = heapq.heappop(heap)
        heapq.heappush(heap, (w + weights[key], s))
        out[key] = s
    return out


def store(spark: SparkSession, path: str, version: int, owner: dict[Key, int]) -> None:
    """Write one version of the map, (version, vslot, cut, salt, shard), to its own folder under `path`; a version is never overwritten."""
    rows = [(version, *key, s) for key, s in sorted(owner.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/version={version:08d}")


def stored(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[Key, int]]:
    """A stored version of the map, the latest unless told; version 0 is empty and means that nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    done = {int(p.getName()[8:]) for p in found if p.getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    version = max(done, default=0) if version is None else version
    if version == 0:
        return 0, {}
    if version not in done:
        raise ValueError(f"version {version} of the slot map is not stored")
    rows = spark.read.schema(MAP).parquet(f"{path}/version={version:08d}").collect()  # a row a slot or sub-slot
    return version, {(r.vslot, r.cut, r.salt): r.shard for r in rows}


def rebalance(spark: SparkSession, path: str, weights: dict[Key, int], shards: int) -> int:
    """Store rebalanced() of the latest map as the next version and return its number."""
    version, owner = stored(spark, path)
    if version == 0:
        raise ValueError("no slot map is stored")
    store(spark, path, version + 1, rebalanced(owner, weights, shards))
    return version + 1


def weights_of(slots: DataFrame) -> dict[Key, int]:
    """Bytes of each key from the map that shard() returns."""
    return {(r.vslot, r.cut, r.salt): r.bytes for r in slots.select("vslot", "cut", "salt", "bytes").collect()}


def _heavy(rows: DataFrame, shards: int) -> list[int]:
    """Hashes of the texts that outweigh a shard's fair share; only slots that do are searched."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()  # SLOTS rows at most
    share = sum(r.bytes for r in sums) / shards
    slots = [r.vslot for r in sums if r.bytes > share]
    if not slots:
        return []
    texts = rows.where(F.col("vslot").isin(slots)).groupBy("hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share)
    return sorted(r.hash for r in texts.collect())  # fewer than shards


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The records with their shard and place, and the slot map.

    `path` holds the stored map, a new one in the shared folder if not told.
    Records go where its latest version says. Without one, version 1 is planned
    and stored; slots that a stored map lacks are added as the next version, and
    no text is cut that the first version did not cut. Either way the map is
    read back before records are placed. A map with fewer shards needs
    rebalance() first, one with more is refused.

    Records: (doc_id, size, text_crc32, shard, slot), slot numbering a shard's
    records from 0 without gaps. Map: (version, vslot, cut, salt, bytes, rows,
    shard). Null ids, null and empty texts and repeated rows are records like
    others (without an id, a record's part of a slot comes from where it was read, so
    only of a cut text has it no lasting place). An empty table gives no records
    and an empty map.
    """
    spark = docs.sparkSession
    path = new_path(spark, "slot-map") if path is None else path
    rows = written(slotted(docs, doc_id, text), "slotted")
    version, owner = stored(spark, path)
    if any(s >= shards for s in owner.values()):
        raise ValueError(f"the stored map has shards beyond {shards}")
    cuts = sorted({cut for _, cut, _ in owner if cut}) if owner else _heavy(rows, shards)
    parts = rows.withColumn("cut", F.when(F.col("hash").isin(cuts), F.col("hash")).otherwise(0) if cuts else F.lit(0).cast("long"))
    sums = parts.groupBy("vslot", "cut", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # (SLOTS + cut texts) * SALTS at most
    weights: dict[Key, int] = {}
    count: dict[Key, int] = {}
    for r in sums:
        key = (r.vslot, r.cut, r.salt if r.cut else 0)
        weights[key], count[key] = weights.get(key, 0) + r.bytes, count.get(key, 0) + r.rows
    if weights.keys() - owner.keys():
        store(spark, path, version + 1, extended(owner, weights, shards))
        version, owner = stored(spark, path, version + 1)
    first, starts = dict.fromkeys(range(shards), 0), []
    for r in sorted(sums, key=lambda r: (r.vslot, r.cut, r.salt)):
        s = owner[r.vslot, r.cut, r.salt if r.cut else 0]
        starts.append((r.vslot, r.cut, r.salt, s, first[s]))
        first[s] += r.rows
    known = spark.createDataFrame(starts, "vslot int, cut long, salt int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("vslot", "cut", "salt").orderBy("doc_id", "text_crc32")) - 1
    out = parts.withColumn("place", place).join(F.broadcast(known), ["vslot", "cut", "salt"])
    slots = spark.createDataFrame([(version, *k, weights[k], count[k], owner[k]) for k in sorted(weights)], "version int, vslot int, cut long, salt int, bytes long, rows long, shard int")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot")), slots
