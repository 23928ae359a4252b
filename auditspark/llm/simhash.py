"""SimHash fingerprints and near-duplicates by exact comparison of fingerprints in tiles.

Within a tile the fingerprints are sorted by population count and cut into small blocks; two blocks are compared by
numpy exclusive-or and bit counts unless their population counts differ by more than the radius, which no pair within
it can. Tiles come from buckets that lose no pair:

* for a small radius, fingerprints of 64 bits share a bucket for each choice of bands that must agree if at most
  ``radius`` of the bands differ (4 bands, radius 2: any 2 of them agree), so work grows far less than with all pairs;
* for word-shingle similarity (``near_duplicate_classes``) no fingerprint is asked. All shingles have one order, common
  ones last; two sets as similar as wanted have a shingle in common among the first of either (prefix filter), so
  documents share a bucket for each of their first shingles. Pairs of a bucket are dropped only by bounds that no wanted
  pair exceeds: the ratio of sizes, and the bits in which parities of the sets differ, which are no more than the
  shingles in which the sets do (512 bits, and for larger sets one to two bits a shingle). What stays is verified on the whole sets of shingles.

A tile gives a spanning forest of its links, never all pairs of a group; equal fingerprints (or texts) are one class
before any comparison, so a group of copies costs one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, group_starts, hot_bound, if_few, join_split, slices, text_frame, texts_of, whole_groups
from auditspark.llm.components import connected_components
from auditspark.llm.tiles import TILE, deal_tiles

SEED = 42
#: Rows of a chunk of a hot bucket, and rows of a block within a tile.
TILE_ROWS, BLOCK_ROWS = 32_768, 1024
#: Shingles of a chunk of texts whose whole sets are compared: 8 MB.
TILE_SHINGLES = 1_000_000
#: Words of the parities of a set. Texts whose shingles set the order, about, and common shingles at most; both bear on speed only.
PARITY_WORDS, ORDER_TEXTS, COMMON = 8, 20_000, 100_000
SIGNS = [f"s{k}" for k in range(PARITY_WORDS)]


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text with A-Z in lower case; of the whole sequence if there are fewer words; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(parts) - words + 1
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; zero for none."""
    count, n = np.zeros(64, dtype=np.int64), len(hashes)
    for start in range(0, n, 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536]).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fp``, the fingerprint as a signed long, of each row. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(shingle_hashes(x, words)) for x in texts_of(part, text_col)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return text_frame(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, fp long")


def close_pairs(words: np.ndarray, radius: int, left: np.ndarray | None = None, right: np.ndarray | None = None, sizes: np.ndarray | None = None, least: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``words`` (n x k unsigned 64-bit words) that differ in ``radius`` bits at most, block by block.

    left, right: rows of either side; without right, pairs within left once. sizes, least: pairs whose sizes have a
    smaller ratio than least are left out.
    """
    count = np.bitwise_count(words[:, 0]).astype(np.int64)
    left = np.arange(len(words)) if left is None else left
    own = right is None
    left = left[np.argsort(count[left], kind="stable")]
    right = left if own else right[np.argsort(count[right], kind="stable")]
    for i in range(0, len(left), BLOCK_ROWS):
        a = left[i : i + BLOCK_ROWS]
        for j in range(i if own else 0, len(right), BLOCK_ROWS):
            b = right[j : j + BLOCK_ROWS]
            if count[b[0]] - count[a[-1]] > radius or count[a[0]] - count[b[-1]] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(words[a, 0][:, None] ^ words[b, 0][None, :]) <= radius)
            if own and i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            x, y = a[x], b[y]
            if words.shape[1] > 1:
                near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1) <= radius
                x, y = x[near], y[near]
            if sizes is not None:
                near = np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y])
                x, y = x[near], y[near]
            if len(x):
                yield x, y


def merge_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each row's least row so far) after the links x-y."""
    while True:
        low = np.minimum(labels[x], labels[y])
        new = labels.copy()
        np.minimum.at(new, labels[x], low)
        np.minimum.at(new, labels[y], low)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _tile_sides(chunk: np.ndarray, tile_a: int, tile_b: int) -> tuple[np.ndarray, np.ndarray | None]:
    return (np.flatnonzero(chunk == tile_a), np.flatnonzero(chunk == tile_b)) if tile_a != tile_b else (np.arange(len(chunk)), None)


def band_keys(fp: Column, bands: int, radius: int) -> list[Column]:
    """A key for each choice of bands - radius bands: pairs within the radius have one in common at least."""
    if not 0 <= radius < bands <= 8 or 64 % bands:
        raise ValueError("bands must divide 64 and be more than the radius")
    width = 64 // bands
    part = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(2**width - 1)) for i in range(bands)]
    return [F.xxhash64(F.lit(n), *(part[i] for i in chosen)) for n, chosen in enumerate(combinations(range(bands), bands - radius))]


def _forest(tiles: DataFrame, node: str, signs: list[str], pairs: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``pairs`` (of signs, sizes, left and right side): a spanning forest of each tile's links."""
    sized = "size" in tiles.columns  # of sets, with their wide parities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILE):
            starts = group_starts(rows, TILE)
            words = np.stack([rows[c].to_numpy().view(np.uint64) for c in signs], axis=1)
            nodes, chunk = rows[node].to_numpy(), rows["chunk"].to_numpy()
            tile_a, tile_b = rows["tile_a"].to_numpy(), rows["tile_b"].to_numpy()
            sizes = rows["size"].to_numpy() if sized else None
            wide = rows["wide"].combine_chunks() if sized else None
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                labels, own = np.arange(end - start), nodes[start:end]
                left, right = _tile_sides(chunk[start:end], tile_a[start], tile_b[start])
                given = (sizes[start:end], Wide(wide.slice(start, end - start))) if sized else (None, None)
                for x, y in pairs(words[start:end], *given, left, right):
                    new = labels[x] != labels[y]
                    if new.any():
                        labels = merge_labels(labels, x[new], y[new])
                moved = np.flatnonzero(labels != np.arange(len(own)))
                if len(moved):
                    links.append((own[moved], own[labels[moved]]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[i] for k in links])) for i in (0, 1)], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def linked_fingerprints(distinct: DataFrame, radius: int = 2, bands: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct ``fp`` to links ``(a, b)`` of fingerprints within the radius: a spanning forest of each tile's links."""
    rows = distinct.select("fp", F.explode(F.array(*band_keys(F.col("fp"), bands, radius))).alias("bucket"))
    pairs = lambda signs, _, __, left, right: close_pairs(signs, radius, left, right)
    return _forest(deal_tiles(rows, "fp", tile_rows).select("fp", "chunk", *TILE), "fp", ["fp"], pairs)


def simhash_components(df: DataFrame, words: int = 3, radius: int = 2, bands: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable by links.

    Defined cases: null, empty and wordless texts have fingerprint zero, linked like any other; fewer words than a
    shingle are one shingle; a null id has a fingerprint and the component of its group, but is no component's id;
    repeated rows give one row each; an empty table gives an empty table; very long texts are read whole; other columns
    are ignored.
    """
    found = checkpoint(simhash(df, words, id_col, text_col))
    classes = checkpoint(found.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n_rows")))
    roots = connected_components(linked_fingerprints(classes.select("fp"), radius, bands))
    rooted = checkpoint(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_classes"))
    bound = hot_bound(found.count())
    classes = join_split(rooted, groups, "root", "n_classes", bound).select("fp", "component_id", "n_rows")
    return join_split(found, classes, "fp", "n_rows", bound).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def prefix_length(size: int, similarity: float) -> int:
    """First shingles of a set of which another as similar as wanted must have one among its own first."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def first_shingles(hashes: np.ndarray, similarity: float, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set of shingle hashes in the order of all shingles: by ``level`` for those in the sorted ``common``, which others precede, then by hash."""
    if not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    rank = np.where(common[at] == hashes, level[at], 0) if len(common) else np.zeros(len(hashes), dtype=np.int64)
    return hashes[np.argsort(rank, kind="stable")[: prefix_length(len(hashes), similarity)]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes fall in each of 64 * PARITY_WORDS cells. Sets that differ in d hashes differ in d bits at most."""
    bits = 64 * PARITY_WORDS
    cell = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    odd = np.bincount(cell.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wide_parities(hashes: np.ndarray) -> np.ndarray:
    """The same in one to two cells a hash, for sets too large for the fixed number of cells; empty for others."""
    bits = 64 * PARITY_WORDS
    if len(hashes) <= bits:
        return np.zeros(0, dtype=np.int64)
    bits = 1 << (len(hashes) - 1).bit_length()
    cell = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    odd = np.bincount(cell.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _halved(words: np.ndarray) -> np.ndarray:
    """Rows of parities in half as many cells: each is the sum of two neighbours."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little").view(np.uint64)


class Wide:
    """Wide parities of the rows of a tile. Of two rows the one with more cells is brought to those of the other."""

    def __init__(self, lists: pa.Array):
        self.at, self.values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        self.words, self.cells = np.diff(self.at), {}

    def _matrix(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words not in self.cells:
            same, more = np.flatnonzero(self.words == words), np.flatnonzero(self.words == 2 * words)
            of = lambda rows, n: self.values[self.at[rows][:, None] + np.arange(n)] if len(rows) else np.zeros((0, n), dtype=np.uint64)
            place = np.full(len(self.words), -1, dtype=np.int64)
            place[np.concatenate([same, more])] = np.arange(len(same) + len(more))
            self.cells[words] = place, np.concatenate([of(same, words), _halved(of(more, 2 * words)) if len(more) else of(same[:0], words)])
        return self.cells[words]

    def close(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether pairs differ in ``most`` cells at most; true for those without wide parities."""
        out = np.ones(len(x), dtype=bool)
        words = np.minimum(self.words[x], self.words[y])
        for n in np.unique(words[words > 0]).tolist():
            place, cells = self._matrix(n)
            some = np.flatnonzero(words == n)
            for start in range(0, len(some), max(1, 2_000_000 // n)):
                part = some[start : start + max(1, 2_000_000 // n)]
                apart = np.bitwise_count(cells[place[x[part]]] ^ cells[place[y[part]]]).sum(axis=1, dtype=np.int64)
                out[part] = apart <= most[part]
        return out


def possible_pairs(signs: np.ndarray, sizes: np.ndarray, similarity: float, left: np.ndarray | None = None, right: np.ndarray | None = None, wide: Wide | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that sizes and parities allow to be as similar as wanted, block by block; no pair that is gets lost.

    Sets of sizes m and n and that similarity differ in (1 - similarity) / (1 + similarity) * (m + n) shingles at most:
    this is the radius. Blocks whose sizes, or whose parities' population counts, are further apart are skipped.
    """
    share = (1 - similarity) / (1 + similarity)
    ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int64)
    left = np.arange(len(signs)) if left is None else left
    own = right is None
    left = left[np.lexsort((ones[left], sizes[left]))]
    right = left if own else right[np.lexsort((ones[right], sizes[right]))]
    for i in range(0, len(left), BLOCK_ROWS):
        a = left[i : i + BLOCK_ROWS]
        for j in range(i if own else 0, len(right), BLOCK_ROWS):
            b = right[j : j + BLOCK_ROWS]
            if sizes[a[-1]] < similarity * sizes[b[0]] - 1e-6:
                break
            if sizes[b[-1]] < similarity * sizes[a[0]] - 1e-6:
                continue
            if max(ones[b].min() - ones[a].max(), ones[a].min() - ones[b].max()) > share * (sizes[a[-1]] + sizes[b[-1]]) + 1e-6:
                continue
            apart = np.zeros((len(a), len(b)), dtype=np.int16)
            for k in range(signs.shape[1]):
                apart += np.bitwise_count(signs[a, k][:, None] ^ signs[b, k][None, :])
            x, y = np.nonzero(apart <= share * (sizes[a][:, None] + sizes[b][None, :]) + 1e-6)
            if own and i == j:
                x, y = x[x < y], y[x < y]
            x, y = a[x], b[y]
            near = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-6
            x, y = x[near], y[near]
            if wide is not None and len(x):
                near = wide.close(x, y, share * (sizes[x] + sizes[y]) + 1e-6)
                x, y = x[near], y[near]
            if len(x):
                yield x, y


def common_shingles(df: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that over a thousandth of some texts have, and how common each is.

    They only set the order of shingles. Any order gives the same links; this one keeps buckets small.
    """
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(math.ceil((df.count() + 1) / ORDER_TEXTS))) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.unique(shingle_hashes(x, words)) for x in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    counts = texts.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > max(4, ORDER_TEXTS // 1000))
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    found = np.array([r.shingle for r in top], dtype=np.int64).view(np.uint64)
    level = np.array([r.n.bit_length() for r in top], dtype=np.int64)
    order = np.argsort(found)
    return found[order], level[order]


def _signatures(df: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``key`` (of equal texts), the id, the number of distinct shingles, the first of them and the parities of each row."""
    order = df.sparkSession.sparkContext.broadcast(common_shingles(df, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(x, words)) for x in texts_of(part, text_col)]
                first = [first_shingles(x, similarity, *order.value).view(np.int64) for x in sets]
                signs = np.stack([parities(x) for x in sets]).view(np.int64)
                sizes = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sizes, pa.array(first, pa.list_(pa.int64())), pa.array([wide_parities(x) for x in sets], pa.list_(pa.int64())), *(pa.array(x) for x in signs.T.copy())], names=[id_col, "key", "size", "first", "wide", *SIGNS])

    schema = f"`{id_col}` long, key string, size long, first array<long>, wide array<long>, " + ", ".join(f"{c} long" for c in SIGNS)
    return text_frame(df, id_col, text_col).withColumn("key", text_key(F.col(text_col))).mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    """Equal for equal texts only; null is the empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def _sets(df: DataFrame, words: int, text_col: str) -> DataFrame:
    """``node`` and the sorted distinct shingle hashes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(x, words)).view(np.int64) for x in texts_of(part, text_col)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return df.select("node", text_col).mapInArrow(run, "node long, shingles array<long>")


def _verified_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of nodes with enough shingles in common: a spanning forest of each tile's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, TILE):
            starts = group_starts(rows, TILE)
            signs = np.stack([rows[c].to_numpy().view(np.uint64) for c in SIGNS], axis=1)
            nodes, chunk, sizes = rows["node"].to_numpy(), rows["chunk"].to_numpy(), rows["size"].to_numpy()
            tile_a, tile_b = rows["tile_a"].to_numpy(), rows["tile_b"].to_numpy()
            flat, wide = rows["shingles"].combine_chunks(), rows["wide"].combine_chunks()
            offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            a, b = [], []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                labels = np.arange(start, end)
                left, right = _tile_sides(chunk[start:end], tile_a[start], tile_b[start])
                for x, y in possible_pairs(signs[start:end], sizes[start:end], similarity, left, right, Wide(wide.slice(start, end - start))):
                    near = np.argsort(np.bitwise_count(signs[start + x] ^ signs[start + y]).sum(axis=1), kind="stable")
                    for at in range(0, len(near), 4096):
                        some = near[at : at + 4096]
                        some = some[labels[x[some]] != labels[y[some]]]
                        for i, j in zip(x[some].tolist(), y[some].tolist(), strict=True):
                            if labels[i] == labels[j]:
                                continue
                            one = values[offsets[start + i] : offsets[start + i + 1]]
                            two = values[offsets[start + j] : offsets[start + j + 1]]
                            common = len(np.intersect1d(one, two, assume_unique=True))
                            if common >= similarity * (len(one) + len(two) - common) - 1e-9:
                                labels[labels == labels[j]] = labels[i]
                                a.append(nodes[start + i])
                                b.append(nodes[start + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicate_classes(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per distinct text: ``key``, ``least`` (its least id), ``n_rows``, and ``root``, the node that stands for its class; ``node`` = ``root`` for one text of each class.

    Texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more; no such link is lost.
    Links between different texts are looked for among those that share one of their first shingles in the order of all
    shingles, as two so similar sets must. Buckets of the same texts are one. Texts that possible pairs bring together,
    directly or over others, are one bucket; in it a pair is linked only if the whole sets agree, so that each set is
    shuffled once. Texts without words are linked with equal texts only.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    rows = checkpoint(_signatures(df, words, similarity, id_col, text_col))
    classes = rows.groupBy("key").agg(F.min(id_col).alias("least"), F.count("*").alias("n_rows"))
    # a text's node is its least id; texts that have no id at all, or share one, get a number of their own
    shared = classes.groupBy("least").agg(F.count("*").alias("n")).where("n > 1 and least is not null").select(F.col("least"), F.lit(True).alias("shared"))
    node = F.when(F.col("least").isNull() | F.col("shared") | (F.col("least") < 0), F.bitwise_not(F.abs(F.xxhash64("key")))).otherwise(F.col("least"))
    classes = checkpoint(classes.join(shared, "least", "left").select("key", "least", "n_rows", node.alias("node")))
    # shingles and parities stay where they are but for texts of several rows: of these one row's are taken
    odd = if_few(checkpoint(classes.where("n_rows > 1 or not node <=> least").select(F.col("key").alias("odd_key"), "least", "node")))
    parts = ["node", "size", "first", "wide", *SIGNS]
    alone = rows.join(odd, rows["key"] == odd["odd_key"], "left_anti").withColumn("node", F.col(id_col))
    one = checkpoint(rows.join(odd, (rows["key"] == odd["odd_key"]) & rows[id_col].eqNullSafe(odd["least"])).dropDuplicates(["key"]).select(parts))
    held = alone.select(parts).unionByName(one)
    sized = held.where("size > 0").select("node", "size", "wide", *SIGNS)
    firsts = held.where("size > 0").select("node", F.explode("first").alias("bucket"))
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    buckets = firsts.groupBy("bucket").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    dealt = checkpoint(firsts.join(buckets.select("bucket"), "bucket"))
    tiles = deal_tiles(dealt, "node", tile_rows, deal=False).join(sized, "node").select("node", "size", "wide", *SIGNS, "chunk", *TILE)
    pairs = lambda signs, sizes, wide, left, right: possible_pairs(signs, sizes, similarity, left, right, wide)
    groups = connected_components(_forest(tiles.repartition(*TILE).sortWithinPartitions(*TILE), "node", SIGNS, pairs))
    grouped = sized.join(groups.withColumnRenamed("root", "bucket"), "node")
    near = checkpoint(deal_tiles(grouped, "node", tile_rows, deal=False, weight="size", tile_weight=TILE_SHINGLES).select("node", "size", "wide", *SIGNS, "chunk", *TILE))
    wanted = if_few(checkpoint(near.select("node").distinct().join(classes.select("node", "key", "least"), "node")))
    texts = df.select(F.col(id_col).cast("long").alias("least"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(wanted, wanted["key"].eqNullSafe(texts["key"]) & wanted["least"].eqNullSafe(texts["least"])).select("node", "text").dropDuplicates(["node"])
    sets = _sets(texts, words, "text")
    joined = near.join(sets, "node").repartition(*TILE).sortWithinPartitions(*TILE)
    roots = connected_components(_verified_links(joined, similarity))
    return classes.join(roots, "node", "left").select("key", "least", "n_rows", "node", F.coalesce("root", "node").alias("root"))


def keep_one_of_each(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with its columns, one of each group of near copies.

    The row that stays has the least id of the group's least node. Defined cases: null and empty texts are one group of
    equal texts; a null id stays if all rows of its text have none and the group no other; of repeated rows one stays;
    an empty table gives an empty table; other columns go along unchanged.
    """
    classes = checkpoint(near_duplicate_classes(df, words, similarity, id_col, text_col))
    stay = classes.where("node = root").select("key", "least")
    rows = df.select(text_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("least"))
    rows = checkpoint(rows.groupBy("key", "least").agg(F.count("*").alias("n")))
    gone = if_few(checkpoint(rows.join(stay, _same_row(rows["key"], rows["least"], stay), "left_anti")))
    kept = df.withColumns({"__key": text_key(F.col(text_col)), "__least": F.col(id_col).cast("long")})
    same = lambda side: _same_row(F.col("__key"), F.col("__least"), side)
    kept = kept.join(gone, same(gone), "left_anti")
    twice = checkpoint(rows.where("n > 1"))
    if not twice.isEmpty():
        twice = if_few(twice)
        kept = kept.join(twice, same(twice), "left_anti").unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["__key"]))
    return kept.select(*df.columns)


def _same_row(key: Column, least: Column, side: DataFrame) -> Column:
    return (key == side["key"]) & least.eqNullSafe(side["least"])
