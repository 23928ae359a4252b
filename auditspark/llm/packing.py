"""Best-fit packing: a configuration linear program over the histogram of lengths, solved by multiplicative weights, then rounded.

Documents become token ids and an end id; only longer ones than the capacity are cut. Spark counts how many pieces have
each length (at most ``CAPACITY`` numbers, whatever the data). From these numbers alone the driver makes a plan:

1. Lengths are put into classes of about equal tokens. A configuration says how many pieces of each class share a sequence.
   The linear program (fewest sequences that cover every class) is solved by multiplicative weights: the scarcer a class
   has been so far, the higher its price; a knapsack dynamic program finds the configuration of the highest price.
2. Its shares are rounded down. Configurations take runs of pieces of their classes, longest first.
3. What is left goes, longest first, where the least room that suffices is: best fit over groups of equal sequences.

Sequences that are filled alike are one group, so the plan has as many rows as groups were split, not as there are pieces.
Pieces get a rank among those of their length, and the plan says which ranks go where; nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from auditspark.llm.common import shared_path, slices, text_frame, texts_of

#: Tokens of a sequence, and the id after each document.
CAPACITY, END_ID = 4096, 1
#: Classes of lengths, rounds of prices and their rate; parts of the program's solution, of which the best is taken.
CLASSES, ROUNDS, RATE, PARTS = 96, 2000, 0.25, (0.25, 0.5, 0.75, 0.9, 1.0)
#: Pieces of one length that are ranked in one task, about; chunks of text whose ids a worker keeps.
RANKED, CACHE_ENTRIES = 1024, 1_200_000
#: Signs that, in a row after a word, are one pre-token.
SIGNS = ".,;:!?)]}(\"|$&*%#-+=/"
#: Words of letters below this one (Latin, Greek, Cyrillic) are letters in every version of Unicode that libraries may have.
LETTERS = "\u0530"


class Encoder(dict):
    """Ids of chunks of texts between blanks, as the library gives them, as little-endian unsigned 32-bit numbers; a chunk is encoded when it is first asked for.

    The tokenizer drops white space and never joins what stands on both sides of it, nor a word and signs after it. A word of
    letters alone is one of its pre-tokens: it goes through the normaliser and the byte alphabet (which change no small
    ASCII letters) to the model, without the search for pre-tokens and offsets.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def _ids(self, chunk: str) -> list[int]:
        norm = chunk if chunk.isascii() else self.tokenizer.normalizer.normalize_str(chunk)
        if norm.isalpha() and max(norm) < LETTERS:
            word = norm if norm.isascii() else self.alphabet.pre_tokenize_str(norm)[0][0]
            return [t.id for t in self.model.tokenize(word)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(SIGNS)
        if chunk.isascii() and chunk.isalpha() and not chunk.islower():
            ids = self[chunk.lower()]
        elif word and len(word) < len(chunk) and word[-1].isalpha() and "<" not in chunk:  # not within the name of a special token
            ids = self[word] + self[chunk[len(word) :]]
        else:
            ids = array("I", self._ids(chunk)).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``at``, which no other piece has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = encoder_of(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 64):
                rows: list[tuple] = []
                for k, ids in enumerate(map(encoder.encode, texts_of(part, text_col))):
                    ids += int(end_id).to_bytes(4, "little")
                    rows += [(k, i, i * capacity, ids[4 * i * capacity : 4 * (i + 1) * capacity]) for i in range(-(-len(ids) // (4 * capacity)))]
                of, piece, start, ids_of = zip(*rows, strict=True) if rows else ((), (), (), ())
                columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids_of], pa.int64())]
                columns += [pa.array([zlib.crc32(x) for x in ids_of], pa.int64()), pa.array(range(at, at + len(rows)), pa.int64())]
                at += len(rows)
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "at"])

    return text_frame(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, at long")


def length_classes(lengths: np.ndarray, counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each length (ascending): neighbours of about equal tokens together."""
    tokens = np.cumsum(lengths * counts)
    return np.unique((tokens - lengths * counts / 2) * classes // max(1, tokens[-1]), return_inverse=True)[1]


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each class in the sequence of the highest price: a knapsack by dynamic programming."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
        for b in range(size, capacity + 1, size):  # within a stretch of one size no entry depends on another
            here = value[b : b + size]
            with_one = value[b - size : b - size + len(here)] + price
            better = with_one > here
            here[better] = with_one[better]
            last[b : b + size][better] = g
    found, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while last[room] >= 0:
        found[last[room]] += 1
        room -= int(sizes[last[room]])
    return found


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, float]]:
    """A solution of the covering program by multiplicative weights: configurations and how many sequences each has, most first."""
    covered, used = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        # the weight of a class falls by a factor each time that all its pieces have been covered once more
        prices = np.exp(rate * (covered.min() - covered)) / counts
        config = best_configuration(sizes, prices, capacity)
        gain = config / counts
        step = 1 / gain.max()  # as often as the class that it uses up first allows
        covered += step * gain
        used[config.tobytes()] = used.get(config.tobytes(), 0) + step
    scale = 1 / max(covered.min(), 1.0)
    return sorted(((np.frombuffer(c, dtype=np.int64), x * scale) for c, x in used.items()), key=lambda p: (-p[1], p[0].tolist()))


class Plan:
    """Rows: length, first rank, pieces, first sequence, sequences, offset. The piece of rank first + j is in sequence first + j mod n, j div n lengths after the offset."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.groups: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of sequences
        self.rooms: list[int] = []  # ascending

    def open(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, n

    def keep(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.groups:
                insort(self.rooms, room)
            self.groups.setdefault(room, []).append((first, n))

    def put(self, length: int, rank: int, each: int, room: int, first: int, n: int) -> None:
        self.rows.append((length, rank, each * n, first, n, self.capacity - room))

    def fit(self, length: int, rank: int, n: int) -> None:
        """``n`` pieces of a length, each where the least room that suffices is, or into new sequences."""
        while n:
            k = bisect_left(self.rooms, length)
            if k < len(self.rooms):
                room = self.rooms[k]
                first, many = self.groups[room].pop()
                if not self.groups[room]:
                    del self.groups[room], self.rooms[k]
            else:
                room = self.capacity
                first, many = self.open(-(-n // (room // length)))
            each = max(1, min(room // length, n // many))
            full = min(many, n // each)
            self.put(length, rank, each, room, first, full)
            self.keep(room - each * length, first, full)
            self.keep(room, first + full, many - full)
            rank, n = rank + each * full, n - each * full


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan for ``counts`` pieces of each of the ascending ``lengths``: of the parts of the program's solution that are tried, that with the fewest sequences."""
    small = lengths < capacity
    if not small.any():
        return _rounded([], [], lengths, counts, capacity, 0)
    of = length_classes(lengths[small], counts[small])
    n_of = np.bincount(of, counts[small])
    sizes = np.maximum(1, np.rint(np.bincount(of, lengths[small] * counts[small]) / n_of)).astype(np.int64)
    members = [np.flatnonzero(of == g)[::-1].tolist() for g in range(len(n_of))]  # longest first
    solution = configurations(sizes, n_of, capacity)
    return min((_rounded(solution, members, lengths, counts, capacity, part) for part in PARTS), key=lambda plan: plan.sequences)


def _rounded(solution: list[tuple[np.ndarray, float]], members: list[list[int]], lengths: np.ndarray, counts: np.ndarray, capacity: int, part: float) -> Plan:
    """The plan that takes ``part`` of each configuration's share, rounded down, and puts all that is left by best fit."""
    plan, left, rank = Plan(capacity), counts.astype(np.int64).copy(), np.zeros(len(lengths), dtype=np.int64)
    every = np.flatnonzero(lengths < capacity)[::-1].tolist()
    for config, share in solution:
        slots = [g for g in np.flatnonzero(config)[::-1].tolist() for _ in range(int(config[g]))]
        n = int(min(share * part, *(sum(int(left[k]) for k in members[g]) // int(config[g]) for g in set(slots))))
        if n:
            groups = [(capacity, *plan.open(n))]
            for g in slots[:-1]:
                groups = [x for room, first, n in groups for x in _runs(plan, members[g], lengths, left, rank, room, first, n)]
            # the last piece is the longest of any class that fits
            for room, first, n in [x for room, first, n in groups for x in _runs(plan, every, lengths, left, rank, room, first, n)]:
                plan.keep(room, first, n)
    for k in np.flatnonzero(left)[::-1].tolist():
        plan.fit(int(lengths[k]), int(rank[k]), int(left[k]))
    return plan


def _runs(plan: Plan, members: list[int], lengths: np.ndarray, left: np.ndarray, rank: np.ndarray, room: int, first: int, n: int) -> Iterator[tuple[int, int, int]]:
    """One piece of the class for each of ``n`` sequences: the longest that fits, in runs of equal lengths. Yields what becomes of the group."""
    for k in members:
        if not n:
            return
        some = min(n, int(left[k])) if lengths[k] <= room else 0
        if some:
            plan.put(int(lengths[k]), int(rank[k]), 1, room, first, some)
            left[k] -= some
            rank[k] += some
            yield room - int(lengths[k]), first, some
            first, n = first + some, n - some
    if n:
        yield room, first, n


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    Defined cases: null and empty texts are the end id alone; very long texts are cut, into pieces of ``capacity`` but for
    the last; repeated ids and rows are packed each; a null id stays null; which of the pieces of one length stands where
    follows from where it was read and is else of no account; an empty table gives an empty table; other columns are ignored.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "pieces")
    pieces(df, tokenizer_path, capacity, end_id, id_col, text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    found = rows.groupBy("length").count().orderBy("length").toPandas()  # at most ``capacity`` rows
    lengths, counts = found["length"].to_numpy(np.int64), found["count"].to_numpy(np.int64)
    plan = np.array(pack(lengths, counts, capacity).rows if len(lengths) else [], dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)

    # a length that many pieces have is ranked in many tasks
    parts = spark.createDataFrame([(n, c // RANKED + 1) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)], "length long, parts long")
    rows = rows.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("at"), "parts"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("at"))).join(firsts, ["length", "part"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            _, begin, _, first, n, offset = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
            columns = [*batch.columns[:5], pa.array(first + (rank - begin) % n), pa.array(offset + (rank - begin) // n * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
