"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring of 64-bit hashes is cut into a fixed number of slices. Spark sums sizes and rows per slice (combined before the
shuffle); these sums, whose number does not depend on the data, are all that the driver sees. It walks the slices, large
ones first: a slice goes to the shard of the first virtual node clockwise from it, or, if that shard is full, to the next
node clockwise whose shard has room. A shard is full at (1 + ``SLACK``) times the mean size; a slice larger than all the
room there is goes to the least full shard. So sizes are near equal whatever the keys; a further shard moves about
1 / (n + 1) of the keys to itself and some that overflow elsewhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of the ring, virtual nodes of a shard, and the part of the mean by which a shard may exceed it.
SLICES, NODES, SLACK = 65_536, 128, 0.002


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of numbers, for the places of nodes and the order of slices."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, nodes: int = NODES, slices: int = SLICES) -> tuple[np.ndarray, np.ndarray]:
    """Slices at which the virtual nodes stand, in ring order, and the shard of each."""
    place = _mixed(np.arange(shards * nodes)) % np.uint64(slices)
    order = np.lexsort((np.arange(shards * nodes), place))
    return place[order].astype(np.int64), order // nodes


def place_slices(sizes: np.ndarray, shards: int, slack: float = SLACK, nodes: int = NODES) -> np.ndarray:
    """The shard of each slice, under the bound on loads."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    at, owner = ring(shards, nodes, len(sizes))
    full = (1 + slack) * int(sizes.sum()) / shards
    load, found = np.zeros(shards, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    first = np.searchsorted(at, np.arange(len(sizes))) % len(at)
    # larger slices first, by powers of two, and within these in a hashed order: the small ones then fill what is left
    order = np.lexsort((_mixed(np.arange(len(sizes)) + (1 << 32)), -np.log2(sizes + 1).astype(np.int64)))
    for s in order.tolist():
        k, size = int(first[s]), int(sizes[s])
        if load.min() + size > full:
            k = int(np.flatnonzero(owner == load.argmin())[0])  # larger than all the room there is
        else:
            while load[owner[k]] + size > full:
                k = (k + 1) % len(at)
        found[s] = owner[k]
        load[owner[k]] += size
    return found


def assign_shards(df: DataFrame, shards: int = 8, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null).

    Defined cases: null text has size 1 and the checksum of the empty text; a null id is placed by its text; repeated ids
    go to one shard and repeated rows have slots one after another; an empty table gives an empty table; other columns
    are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(F.coalesce(id_col, -1 - F.col("text_crc32"))), F.lit(SLICES)).cast("int"))
    sums = rows.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()
    sizes, counts = np.zeros(SLICES, dtype=np.int64), np.zeros(SLICES, dtype=np.int64)
    sizes[sums["slice"]], counts[sums["slice"]] = sums["bytes"], sums["n"]
    shard = place_slices(sizes, shards, slack)
    first = np.zeros(SLICES, dtype=np.int64)
    for k in range(shards):
        own = shard == k
        first[own] = np.cumsum(counts[own]) - counts[own]
    # SLICES numbers each: a bound that does not depend on the data
    plan = df.sparkSession.createDataFrame([(list(map(int, shard)), list(map(int, first)))], "shards array<int>, firsts array<long>")
    plan = plan.select(F.posexplode(F.arrays_zip("shards", "firsts"))).select(F.col("pos").alias("slice"), F.col("col.shards").alias("shard"), F.col("col.firsts").alias("first"))
    within = Window.partitionBy("slice").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(within)).join(F.broadcast(plan), "slice")
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
