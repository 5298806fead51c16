"""Sharding (operator 7): fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots.  Bytes are aggregated per slot, and a map from slots to shards
is built from them and stored under a version; rebalancing edits the map, never the hashing.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayring.llm._io import new_path, written

SLOTS = 4096
#: Bytes that each record takes besides its text.
OVERHEAD = 16


def balanced_map(slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """Largest slots first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def with_new_shard(current: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """An edit of the map: slots move into shard ``shards`` only, from the fullest shards, until it has its share."""
    out = dict(current)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(out, key=lambda s: (slot_bytes.get(s, 0), s)):
        load[out[slot]] += slot_bytes.get(slot, 0)
        held[out[slot]].append(slot)
    share, got = sum(load) / (shards + 1), 0
    while got < share:
        shard = max(range(shards), key=lambda s: (load[s], -s))
        fitting = [s for s in held[shard] if got + slot_bytes.get(s, 0) <= share * 1.01]
        if not fitting:
            break
        slot = fitting[-1]
        held[shard].remove(slot)
        out[slot] = shards
        load[shard] -= slot_bytes.get(slot, 0)
        got += slot_bytes.get(slot, 0)
    return out


def edited_map(current: dict[int, int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """The map edited for ``shards`` shards and the bytes as they are now; slots that need not move stay.

    New shards are filled one by one, each by moves into it alone; slots of shards that are gone go to the
    emptiest ones; then slots move from the fullest to the emptiest shard until the fullest is within
    ``tolerance`` of the mean or no single move brings the two nearer.
    """
    size = lambda s: slot_bytes.get(s, 0)
    out = dict(current)
    for grown in range(max(out.values(), default=-1) + 1, shards):
        out = with_new_shard(out, slot_bytes, grown)
    load = [0] * shards
    for slot, shard in out.items():
        if shard < shards:
            load[shard] += size(slot)
    for slot in sorted((s for s in out if out[s] >= shards), key=lambda s: (-size(s), s)):
        out[slot] = load.index(min(load))
        load[out[slot]] += size(slot)
    mean = sum(load) / shards
    while max(load) > (1 + tolerance) * mean:
        full, low = load.index(max(load)), load.index(min(load))
        fitting = [s for s in out if out[s] == full and 0 < size(s) <= (load[full] - load[low]) / 2]
        if not fitting:
            break
        slot = max(fitting, key=lambda s: (size(s), -s))
        out[slot] = low
        load[full] -= size(slot)
        load[low] += size(slot)
    return out


def store_map(spark: SparkSession, slot_map: dict[int, int], version: int, path: str) -> None:
    """Append one version of the map; older versions stay readable."""
    rows = [(version, slot, shard) for slot, shard in sorted(slot_map.items())]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A stored version of the map, the newest if none is named; version 0 and no slots where nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, {}
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return version, {r.virtual_slot: r.shard for r in table.where(F.col("version") == version).collect()}


def shard_records(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot`` of every row; the law is ``bytes``.

    The virtual slot is a hash of the id and the text's checksum.  If ``map_path`` holds a map, its newest version
    is edited for the bytes per slot (a fixed number of rows) and the number of shards, and stored as the next
    version if that changed it; else a map of all slots is built and stored as version 1.  ``slot`` is the
    row's place in its shard, gapless from 0: rows before its virtual slot plus its rank within that slot, so
    no shard is ever gathered in one task.  Null texts have only the overhead and checksum 0; null ids hash
    like a value; repeated rows are placed each; ties within a virtual slot are told by id and checksum, and rows alike in
    both are interchangeable; a very long text counts with all its bytes and is one row; other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc.cast("long").alias("text_crc32")).withColumn(
            "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
        ),
        "shard-rows",
    )
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    slot_bytes = {r.virtual_slot: r.bytes for r in held}
    path = map_path or new_path(spark, "slot-map")
    version, stored = load_map(spark, path)
    slot_map = edited_map(stored, slot_bytes, shards) if stored else balanced_map({s: slot_bytes.get(s, 0) for s in range(slots)}, shards)
    if len(slot_map) != slots:
        raise ValueError(f"the map at {path} has {len(slot_map)} slots, not {slots}")
    if slot_map != stored:
        store_map(spark, slot_map, version + 1, path)
    n, placed, start = {s: 0 for s in range(slots)} | {r.virtual_slot: r.n for r in held}, [0] * shards, []
    for slot in sorted(slot_map):
        start.append((slot, slot_map[slot], placed[slot_map[slot]]))
        placed[slot_map[slot]] += n[slot]
    places = F.broadcast(spark.createDataFrame(start, "virtual_slot int, shard int, before long"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(places, "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
    )
