"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Texts are normalised byte for byte: A-Z to lower case, ASCII bytes other than letters and digits to blanks, and cut into
words. Each word of the items has a number, written as two digits of different kinds so that no state has many followers;
all other words are two zeros. The automaton holds the windows (10 consecutive words of an item, or a shorter item whole)
as sequences of digits, so that a match is a run of whole words. Each text is scanned once; where a match ends gives its
last word, and the place of a word in the original follows from the same separators.

The items are a stated query set. They are read in blocks of bounded size, one automaton and one broadcast each; with a
set of one block (``BLOCK_BYTES`` of normalised text) documents are read once, with more they are read once a block and
the hits are put together per document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import slices, text_frame, texts_of

#: Words of a window, and bytes of the items of one automaton at most (a larger item has one to itself): about 280 MB in a worker.
WINDOW, BLOCK_BYTES = 10, 1_800_000
#: Fixed: what a byte becomes. Words are runs of ASCII letters and digits and of all bytes from 128 on.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The digits of a word that no item has.
UNKNOWN = (0, 0)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


class Windows:
    """Windows of a block of items: each with the items that have it. Items of the same id are one."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids, numbers_of, found = sorted({i for i, _ in items}), {}, {}
        place = {i: k for k, i in enumerate(self.ids)}
        for item, text in items:
            numbers = [numbers_of.setdefault(w, len(numbers_of)) for w in words_of(text)]
            for i in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found.setdefault(tuple(numbers[i : i + window]), set()).add(place[item])
        self.found = {key: tuple(sorted(owners)) for key, owners in found.items()}
        base = math.isqrt(len(numbers_of)) + 1
        self.digits = {w: (1 + k // base, 1 + base + k % base) for w, k in numbers_of.items()}
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            digits = list(self.digits.values())
            for key, owners in self.found.items():
                self._automaton.add_word(tuple(chain.from_iterable(digits[k] for k in key)), (len(key), owners))
            if self.found:
                self._automaton.make_automaton()
        return self._automaton

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        owners: set[int] = set()
        if not words or not self.found:
            return np.zeros(len(words), dtype=bool), owners
        digits = self.digits.get
        for end, (n, of) in self.automaton.iter(tuple(chain.from_iterable([digits(w, UNKNOWN) for w in words]))):
            last = end // 2
            hit[last - n + 1] += 1
            hit[last + 1] -= 1
            owners.update(of)
        return np.cumsum(hit[:-1]) > 0, owners


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """The items in blocks of ``BLOCK_BYTES``, one block on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    block, size = [], 0
    for row in items.orderBy("id").toLocalIterator():
        bytes_ = len(row.text.encode("utf-8", "surrogatepass"))
        if block and size + bytes_ > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += bytes_
    if block:
        yield block


def _broadcasts(benchmark: DataFrame, window: int) -> list[Broadcast]:
    spark = benchmark.sparkSession
    return [spark.sparkContext.broadcast(Windows(block, window)) for block in item_blocks(benchmark)]


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _hits(df: DataFrame, model: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, number of words, runs of hit words and ids of items, under one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = model.value
        for batch in batches:
            for part in slices(batch):
                n, runs, items = [], [], []
                for text in texts_of(part, text_col):
                    words = words_of(text)
                    hit, owners = windows.scan(words)
                    n.append(len(words))
                    runs.append(_runs(hit))
                    items.append(sorted(windows.ids[k] for k in owners))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*part.schema.names[:-1], "n_words", "runs", "items"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col]
    return df.select(*[c for c in df.columns if c != text_col], text_col).mapInArrow(run, ", ".join([*kinds, "n_words long", "runs array<long>", "items array<string>"]))


def _runs(hit: np.ndarray) -> list[int]:
    """Begin and end of each run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


def contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``.

    Defined cases: null and empty texts have no words and no hits; items without words have no window; equal items count
    each; items of one id count once, with the windows of all of them; items with a null id are ignored; repeated rows and ids give one row each; without items, or for an empty
    table, nothing is hit; very long texts are scanned whole; other columns are ignored.
    """
    blocks = _broadcasts(benchmark, window)
    base = text_frame(df, id_col, text_col)
    if len(blocks) > 1:
        # rows have no key of their own: the parts of a row meet by its id and text
        base = base.withColumn("__text_key", F.sha2(F.col(text_col), 256))
        parts = [_hits(base, b, id_col, text_col) for b in blocks]
        every = parts[0].withColumn("block", F.lit(0))
        for k, part in enumerate(parts[1:], 1):
            every = every.unionByName(part.withColumn("block", F.lit(k)))
        return _merged(every, id_col)
    spark = df.sparkSession
    model = blocks[0] if blocks else spark.sparkContext.broadcast(Windows([], window))
    return _digest(_hits(base, model, id_col, text_col), id_col)


def _digest(hits: DataFrame, id_col: str) -> DataFrame:
    ends = F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return hits.select(
        id_col, "n_words", ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


def _merged(every: DataFrame, id_col: str) -> DataFrame:
    """Hits of several automata put together: runs are united word by word, per distinct id and text."""

    @F.pandas_udf("array<long>")
    def united(lists):
        def one(runs):
            edges = sorted((p, 1 - 2 * (i % 2)) for r in runs for i, p in enumerate(r))
            edges.sort(key=lambda e: (e[0], -e[1]))
            out, depth = [], 0
            for at, step in edges:
                if depth == 0 and step == 1 and not (out and out[-1] == at):
                    out.append(at)
                elif depth == 0 and step == 1:
                    out.pop()
                depth += step
                if depth == 0:
                    out.append(at)
            return out

        return lists.map(one)

    merged = every.groupBy(id_col, "__text_key").agg(
        F.max("n_words").alias("n_words"), F.collect_set("runs").alias("all_runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum((F.col("block") == 0).cast("int")).alias("times")
    )
    merged = merged.withColumn("runs", united("all_runs")).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return _digest(merged, id_col)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with its columns whose text holds no window of an item; null and empty texts stay."""
    for model in _broadcasts(benchmark, window):

        def run(batches: Iterator[pa.RecordBatch], model: Broadcast = model) -> Iterator[pa.RecordBatch]:
            windows = model.value
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array([not windows.scan(words_of(t))[1] for t in texts_of(part, text_col)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def hit_spans(text: str, windows: Windows) -> list[tuple[int, int]]:
    """Offsets (code points of the original text) of each run of hit words."""
    hit, _ = windows.scan(words_of(text))
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.frombuffer(raw.translate(BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, kinds.astype(np.int8), 0]))
    begin, end = edges[::2], edges[1::2]
    runs = _runs(hit)
    point = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
    return [(point(int(begin[a])), point(int(end[b - 1]))) for a, b in zip(runs[::2], runs[1::2], strict=True)]
