"""Sharding over fixed virtual slots.

Every row is hashed by its id into one of ``SLOTS`` slots, for good. What moves is the map from slots to shards: it is built from the bytes
of the slots, stored by version, and edited (a few slots change their shard) when shards are added or have become uneven.
Only the slot totals reach the driver; their number is fixed. Rows find their shard by a join with the map, which is as small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paytrail.sources.scratch import pin
from paytrail.sources.sinks import finished

SLOTS = 8192
MAP_SCHEMA = T.StructType([T.StructField("virtual_slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False)])

Totals = dict[int, int]


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: a hash of its text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def new_map(totals: Totals, shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots by falling bytes, each to the shard with the fewest bytes so far. Ties: smaller slot, smaller shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-totals.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + totals.get(slot, 0), shard))
    return out


def edit_map(now: dict[int, int], totals: Totals, shards: int) -> dict[int, int]:
    """Moves slots from the fullest to the emptiest shard while that lessens their difference; all other slots stay where they are.

    New shards start empty. Slots of shards that no longer exist (number >= ``shards``) are dealt out first, largest first.
    """
    out = dict(now)
    load = dict.fromkeys(range(shards), 0)
    own: dict[int, list[tuple[int, int]]] = {s: [] for s in load}
    lost = []
    for slot, shard in now.items():
        if shard in load:
            load[shard] += totals.get(slot, 0)
            own[shard].append((totals.get(slot, 0), slot))
        else:
            lost.append((totals.get(slot, 0), slot))
    for size, slot in sorted(lost, key=lambda x: (-x[0], x[1])):
        to = min(load, key=lambda s: (load[s], s))
        out[slot] = to
        load[to] += size
        own[to].append((size, slot))
    while True:
        full, empty = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        best = max(((size, -slot) for size, slot in own[full] if 0 < size < gap), key=lambda x: (-abs(gap - 2 * x[0]), x[1]), default=None)
        if best is None:
            return out
        size, slot = best[0], -best[1]
        own[full].remove((size, slot))
        own[empty].append((size, slot))
        load[full] -= size
        load[empty] += size
        out[slot] = empty


def grow_map(now: dict[int, int], totals: Totals) -> dict[int, int]:
    """One more shard: slots move only into the new one, from the fullest shard each time, until it holds its share."""
    shards = max(now.values(), default=-1) + 1
    load = dict.fromkeys(range(shards), 0)
    own: dict[int, list[tuple[int, int]]] = {s: [] for s in load}
    for slot, shard in now.items():
        load[shard] += totals.get(slot, 0)
        own[shard].append((totals.get(slot, 0), slot))
    share, got, out = sum(load.values()) / (shards + 1), 0, dict(now)
    for rows in own.values():
        rows.sort(reverse=True)
    while shards:
        full = max(load, key=lambda s: (load[s], -s))
        pick = next((x for x in own[full] if 0 < x[0] <= share - got), None)
        if pick is None:
            return out
        own[full].remove(pick)
        load[full] -= pick[0]
        got += pick[0]
        out[pick[1]] = shards
    return out


def as_table(spark: SparkSession, rows: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(rows.items()), MAP_SCHEMA)


def write_map(spark: SparkSession, rows: dict[int, int], folder: str, version: int) -> None:
    """Stores a version; a finished one is never overwritten."""
    path = f"{folder.rstrip('/')}/version={version}"
    if finished(spark, path):
        raise ValueError(f"version {version} exists in {folder}")
    as_table(spark, rows).coalesce(1).write.mode("overwrite").parquet(path)


def read_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{folder.rstrip('/')}/version={version}").collect()
    return {r.virtual_slot: r.shard for r in rows}


def slot_totals(rows: DataFrame, size: str, slot: str = "virtual_slot") -> Totals:
    """Bytes by slot: at most ``SLOTS`` rows, whatever the input."""
    return {r[0]: int(r[1] or 0) for r in rows.groupBy(slot).agg(F.sum(size)).collect()}


def row_sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, virtual_slot; one row per input row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id), slots).alias("virtual_slot"),
    )


def place(rows: DataFrame, table: Iterable[tuple[int, int]] | dict[int, int], order: tuple[str, ...] = ("doc_id", "size", "text_crc32")) -> DataFrame:
    """Adds shard and slot (the row's place in its shard, without gaps from 0).

    The place is the number of rows in the shard's earlier virtual slots plus the rank inside the virtual slot, so no shard is sorted as a
    whole. Rows of equal id share a slot and follow one another; rows equal in all of ``order`` take their places in any order.
    """
    spark = rows.sparkSession
    shard_of = dict(table)
    counts = {r[0]: r[1] for r in rows.groupBy("virtual_slot").count().collect()}
    base, seen = [], dict.fromkeys(shard_of.values(), 0)
    for slot in sorted(shard_of):
        base.append((slot, shard_of[slot], seen[shard_of[slot]]))
        seen[shard_of[slot]] += counts.get(slot, 0)
    schema = T.StructType([*MAP_SCHEMA.fields, T.StructField("_base", T.LongType(), False)])
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (
        rows.withColumn("_rank", rank)
        .join(F.broadcast(spark.createDataFrame(base, schema)), "virtual_slot")
        .withColumn("slot", F.col("_base") + F.col("_rank") - 1)
        .drop("_base", "_rank")
    )


def latest_version(spark: SparkSession, folder: str) -> int:
    """The last version; 0 if there is none. A version is one file, which is there whole or not at all."""
    try:
        stored = spark.read.schema(T.StructType([*MAP_SCHEMA.fields, T.StructField("version", T.IntegerType())])).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return stored.agg(F.max("version")).first()[0] or 0


def next_map(spark: SparkSession, totals: Totals, shards: int, folder: str) -> tuple[dict[int, int], int]:
    """The map for the slots' present totals and its version in ``folder``.

    An empty folder gets a new map as version 1. Later the last version is edited; if that moves a slot, the result is stored as the next
    version, else the last one still holds. A version that was cut off while it was written is written again.
    """
    last = latest_version(spark, folder)
    now = read_map(spark, folder, last) if last else {}
    table = edit_map(now, totals, shards) if last else new_map(totals, shards)
    if table == now:
        return now, last
    write_map(spark, table, folder, last + 1)
    return table, last + 1


def shard_documents(docs: DataFrame, shards: int = 24, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version; one row per input row, texts read once.

    ``law`` is ``bytes``: the slots' bytes decide the map, so the sizes of the shards are near equal. ``folder``: where the map is stored by
    version; a stored one is edited, so that rows stay in their shards but for the few slots that even the sizes out or leave a shard that is
    given up. Without a folder the map is made anew and nothing is stored (version 0).
    Null texts count as empty; null ids share a slot; an empty table gives no row and a map all the same.
    """
    spark = docs.sparkSession
    rows = pin(row_sizes(docs), "row-sizes").df
    totals = slot_totals(rows, "size")
    table, version = next_map(spark, totals, shards, folder) if folder else (new_map(totals, shards), 0)
    return place(rows, table).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")
    )
