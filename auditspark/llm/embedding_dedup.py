"""Embedding near-duplicates by lattice hashing: random projections decoded to points of the E8 lattice.

In each table a unit vector is projected to blocks of eight dimensions and each block is decoded to its nearest E8 point;
the points of the blocks together are its cell. A vector is stored in its own cell and asks in its own and in the
neighbouring cells that its projection is nearest to. Vectors of a cell are verified by cosine in double precision on
their whole components, so no link below the threshold is made.

Equal vectors are one class before any comparison. A cell with many vectors is dealt out as tiles. Within a tile only
sums and a spanning forest leave: each vector's number of links, and links to one vector of each group. A link that
several cells see is counted in the first of them alone, which both vectors' cells tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, group_starts, hot_bound, join_split, whole_groups
from auditspark.llm.components import connected_components
from auditspark.llm.simhash import merge_labels
from auditspark.llm.tiles import TILE, deal_tiles

#: Tables, blocks of eight dimensions in a cell, neighbouring cells asked, and the lattice's scale on unit vectors of any dimension.
TABLES, BLOCKS, PROBES, SCALE = 6, 2, 5, 4.2
TILE_ROWS, ROWS = 2048, 512


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to rows of eight numbers, doubled to be whole: the nearer of those of D8 and of D8 moved by one half."""
    whole, moved = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - moved) ** 2).sum(axis=1)
    return np.where(nearer[:, None], 2 * whole, 2 * moved).round().astype(np.int64)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    point = np.rint(x)
    off = x - point
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    k = worst[odd]
    point[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
    return point


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight of one half with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


class Tables:
    """Projections of one dimension, fixed by a seed."""

    def __init__(self, dim: int, seed: int = 20):
        self.dim = dim
        rng = np.random.default_rng([seed, dim])
        width = 8 * BLOCKS
        # each table's directions are orthonormal as far as the dimension allows
        parts = [np.linalg.qr(rng.standard_normal((max(dim, width), width)))[0][:dim] for _ in range(TABLES)]
        self.direction = np.concatenate(parts, axis=1) * SCALE * np.sqrt(max(dim, width) / 64)
        self.shift = rng.random(TABLES * width)
        self.near = minimal_vectors()

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (n x TABLES) and asked neighbouring cells (n x TABLES x PROBES) of unit vectors."""
        n = len(unit)
        x = (unit @ self.direction + self.shift).reshape(n * TABLES * BLOCKS, 8)
        point = decode_e8(x)
        toward = (x - point / 2) @ self.near.T  # nearer neighbours have larger products
        toward = toward.reshape(n * TABLES, BLOCKS * len(self.near))
        best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
        point = point.reshape(n * TABLES, BLOCKS * 8)
        own = self._hash(point, n, self.dim)
        asked = np.empty((n * TABLES, PROBES), dtype=np.int64)
        rows = np.arange(n * TABLES)
        for k in range(PROBES):
            block, which = best[:, k] // len(self.near), best[:, k] % len(self.near)
            other = point.reshape(n * TABLES, BLOCKS, 8).copy()
            other[rows, block] += (2 * self.near[which]).astype(np.int64)
            asked[:, k] = self._hash(other.reshape(n * TABLES, BLOCKS * 8), n, self.dim)
        return own.reshape(n, TABLES), asked.reshape(n, TABLES, PROBES)

    @staticmethod
    def _hash(points: np.ndarray, n: int, dim: int) -> np.ndarray:
        raw = np.ascontiguousarray(points.astype(np.int32))
        table = np.tile(np.arange(TABLES), n)
        return np.array([xxhash.xxh64_intdigest(r.tobytes(), int(t) + 1000 * dim) for r, t in zip(raw, table, strict=True)], dtype=np.uint64).view(np.int64)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of finite components, not all zero, in double precision at length one."""
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hashed(classes: DataFrame) -> DataFrame:
    """``classes`` with the cells of each vector: of each table its own and then the asked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            lengths, first = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
            flat = lists.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for start in range(0, len(rows), ROWS):
                    part = rows[start : start + ROWS]
                    own, asked = tables.setdefault(dim, Tables(dim)).cells(_unit(flat[(first[part][:, None] + np.arange(dim)).ravel()], dim))
                    cells = np.concatenate([own[:, :, None], asked], axis=2).reshape(len(part), -1)
                    cells = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel())
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(part)).columns, cells], names=[*batch.schema.names, "cells"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kinds}, cells array<long>")


def _links(tiles: DataFrame, least: float) -> DataFrame:
    """Rows (a, b, n): n links of node a seen in a tile first, with the number of equal vectors as weight, and a forest's link a-b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILE):
            starts = group_starts(rows, TILE)
            node, slot, chunk, weight = (rows[c].to_numpy() for c in ("node", "slot", "chunk", "weight"))
            tile_a, tile_b = rows["tile_a"].to_numpy(), rows["tile_b"].to_numpy()
            own = slot % (PROBES + 1) == 0
            cells, vectors = rows["cells"].combine_chunks(), rows["embedding"].combine_chunks()
            cells = cells.flatten().to_numpy().reshape(rows.num_rows, -1)
            flat, at = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()
            at = at - at[0]
            out_a, out_b, out_n = [], [], []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                k = end - start
                if k < 2 or not own[start:end].any():
                    continue
                if len(set(np.diff(at[start : end + 1]).tolist())) > 1:
                    raise ValueError("vectors of different length share a cell")  # their cells have other seeds
                x = _unit(flat[at[start] : at[end]], int(at[start + 1] - at[start]))
                count, labels = np.zeros(k, dtype=np.int64), np.arange(k)
                left = np.flatnonzero(chunk[start:end] == tile_a[start])
                right = np.flatnonzero(chunk[start:end] == tile_b[start])
                same = tile_a[start] == tile_b[start]
                for p in range(0, len(left), ROWS):
                    a = left[p : p + ROWS]
                    for q in range(p if same else 0, len(right), ROWS):
                        b = right[q : q + ROWS]
                        i, j = np.nonzero(x[a] @ x[b].T >= least - 1e-9)
                        i, j = a[i], b[j]
                        good = (node[start + i] != node[start + j]) & (own[start + i] | own[start + j])
                        if same:
                            good &= i < j
                        i, j = i[good], j[good]
                        for s in range(0, len(i), 16_384):
                            u, v = i[s : s + 16_384], j[s : s + 16_384]
                            exact = (x[u] * x[v]).sum(axis=1) >= least
                            u, v = u[exact], v[exact]
                            first = _first(cells[start + u], cells[start + v], slot[start + u], slot[start + v])
                            np.add.at(count, u[first], weight[start + v[first]])
                            np.add.at(count, v[first], weight[start + u[first]])
                            if len(u):
                                labels = merge_labels(labels, u, v)
                some = np.flatnonzero((count > 0) | (labels != np.arange(k)))
                if len(some):
                    out_a.append(node[start + some])
                    out_b.append(node[start + labels[some]])
                    out_n.append(count[some])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)], names=["a", "b", "n"])

    return tiles.mapInArrow(run, "a long, b long, n long")


def _first(cells_a: np.ndarray, cells_b: np.ndarray, slot_a: np.ndarray, slot_b: np.ndarray) -> np.ndarray:
    """Whether a pair meets in no cell before this one; the order is by table, then own cells, then the lesser cell."""
    n, width = len(cells_a), PROBES + 1
    table = slot_a // width
    a, b = cells_a.reshape(n, TABLES, width), cells_b.reshape(n, TABLES, width)
    both = a[:, :, 0] == b[:, :, 0]
    a_home = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    b_home = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    met = both | a_home | b_home
    first = met.argmax(axis=1) == table
    rows = np.arange(n)
    # in its first table a pair with different own cells may meet in both; the one with the lesser cell counts
    here = np.where(slot_a % width == 0, a[rows, table, 0], b[rows, table, 0])
    double = a_home[rows, table] & b_home[rows, table] & ~both[rows, table]
    least = np.minimum(a[rows, table, 0], b[rows, table, 0])
    return first & (~double | (here == least))


def embedding_components(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: the id, ``n_links``, ``component_id`` (least id reachable) and ``kept`` (whether that is its own).

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components have no links and are their
    own component; vectors of different length aren't linked; equal vectors are linked with each other; a null id has
    links but is no component's id and isn't kept; repeated rows count as rows of their own; an empty table gives an empty
    table; other columns are ignored.
    """
    vector = F.col(vector_col)
    vector = vector if df.schema[vector_col].dataType.simpleString() == "array<float>" else vector.cast("array<double>")
    usable = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), vector.alias("embedding"), usable.alias("usable"))
    # minus zero and zero are one number
    rows = rows.withColumn("key", F.when(F.col("usable"), F.md5(F.array_join(F.transform("embedding", lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), ",").cast("binary"))))
    keyed = checkpoint(rows.select(id_col, "usable", "key"))
    classes = rows.where("usable").groupBy("key").agg(F.min(id_col).alias("least"), F.count("*").alias("weight"), F.min("embedding").alias("embedding"))
    hashed = checkpoint(_hashed(classes.select("key", F.xxhash64("key").alias("node"), "least", "weight", "embedding")))
    placed = hashed.select("node", F.posexplode("cells").alias("slot", "bucket"))
    tiles = deal_tiles(placed, "node", TILE_ROWS, deal=False, owner=F.col("slot") % (PROBES + 1) == 0).join(hashed.select("node", "weight", "cells", "embedding"), "node").repartition(*TILE).sortWithinPartitions(*TILE)
    tiles = tiles.select("node", "slot", "weight", "chunk", "cells", "embedding", *TILE)
    found = checkpoint(_links(tiles, least))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    rooted = checkpoint(hashed.select("key", "node", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n_classes"))
    bound = hot_bound(keyed.count())
    of = join_split(rooted, groups, "root", "n_classes", bound).join(counts, F.col("node") == F.col("a"), "left").select("key", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component")
    out = join_split(keyed.where("usable"), of, "key", "weight", bound).select(id_col, "links", "component")
    out = out.unionByName(keyed.where("not usable").select(id_col, F.lit(0).cast("long").alias("links"), F.col(id_col).alias("component")))
    component = F.col("component")
    return out.select(id_col, F.col("links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))
