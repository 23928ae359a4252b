"""Target-distribution importance resampling: documents are drawn in proportion to how much likelier their hashed n-grams are in a target.

Features are runs of one to three words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. Counts of buckets, whose number
does not depend on the data, give an array of gains; an array lookup scores each document. A Gumbel noise of the id makes
the highest scores a draw without replacement. Scores are integers: a coarse histogram (bounded, suffix sums on the driver)
says which scores survive, an exact histogram of these alone gives each score's rank offset and the cutoff, and
``row_number`` by id within each surviving score gives ranks. Nothing is sorted as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import shared_path, slices, text_frame, texts_of
from auditspark.llm.decontaminate import words_of

#: Buckets of features, words of the longest run, percent that is drawn, seed of the noise, words that a drawn document has at least.
BUCKETS, RUN, PERCENT, SEED, LEAST_WORDS = 10_000, 3, 5, 42, 20
#: Bins of the coarse histogram at most; words that a worker keeps.
COARSE, WORDS_KEPT = 65_536, 400_000
_BLANK = zlib.crc32(b" ")


def zeros_after(n: int) -> np.ndarray:
    """A CRC-32 is linear: tables, by byte of a checksum, of what ``n`` bytes appended do to it."""
    zeros = bytes(n)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)], dtype=np.uint32)
    tables = np.zeros((4, 256), dtype=np.uint32)
    for k in range(32):
        tables[k // 8, (np.arange(256) >> k % 8 & 1) == 1] ^= bits[k]
    return tables


class Features:
    """Buckets of the runs of words of texts. Checksums of runs are put together from those of their words."""

    def __init__(self, buckets: int = BUCKETS, run: int = RUN):
        self.buckets, self.run = buckets, run
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.slots: dict[int, int] = {}
        self.crc = self.crc_blank = np.zeros(0, dtype=np.uint32)
        self.slot = np.zeros(0, dtype=np.int64)
        self.tables = np.zeros((0, 4, 256), dtype=np.uint32)
        self.one = zeros_after(1)[None]

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > WORDS_KEPT:
            self._clear()
        new = list(dict.fromkeys(w for w in words if w not in self.numbers))
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            lengths = list(dict.fromkeys(n for n in map(len, new) if n not in self.slots))
            self.slots.update(zip(lengths, range(len(self.slots), len(self.slots) + len(lengths)), strict=True))
            self.tables = np.concatenate([self.tables, *(zeros_after(n)[None] for n in lengths)])
            self.crc = np.r_[self.crc, np.array([zlib.crc32(w) for w in new], dtype=np.uint32)]
            self.crc_blank = np.r_[self.crc_blank, np.array([zlib.crc32(w + b" ") for w in new], dtype=np.uint32)]
            self.slot = np.r_[self.slot, np.array([self.slots[len(w)] for w in new], dtype=np.int64)]
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then for all features of all texts the number of the text and the bucket, in no order."""
        worded = [words_of(t) for t in texts]
        n_words = np.array([len(w) for w in worded], dtype=np.int64)
        ids, text = self._ids([w for words in worded for w in words]), np.repeat(np.arange(len(texts)), n_words)
        crc, texts_, buckets = self.crc[ids], [text], [self.crc[ids] % self.buckets]
        for n in range(1, self.run):
            # the run that began here, a blank, and the word n places on, within one text
            head = self.crc_blank[ids[: len(ids) - n]] if n == 1 else (_appended(self.one, 0, crc) ^ np.uint32(_BLANK))[: max(0, len(ids) - n)]
            ids_on = ids[n:]
            crc = _appended(self.tables, self.slot[ids_on], head) ^ self.crc[ids_on]
            inside = text[: len(ids_on)] == text[n:]
            texts_.append(text[n:][inside])
            buckets.append(crc[inside] % self.buckets)
        return n_words, np.concatenate(texts_), np.concatenate(buckets).astype(np.int64)


def _appended(tables: np.ndarray, slot: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """Checksums after as many bytes as the tables at ``slot`` stand for."""
    return tables[slot, 0, crc & 255] ^ tables[slot, 1, crc >> 8 & 255] ^ tables[slot, 2, crc >> 16 & 255] ^ tables[slot, 3, crc >> 24]


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, run: int = RUN, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found = Features(buckets, run), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                found += np.bincount(features.of(texts_of(part, "text"))[2], minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    sums = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most ``buckets`` rows
    found = np.zeros(buckets, dtype=np.int64)
    found[sums["bucket"]] = sums["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm of how much likelier each bucket is in the target, rounded down."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_words``, ``n_features`` and ``weight``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain), run)
        for batch in batches:
            for part in slices(batch):
                n_words, text, bucket = features.of(texts_of(part, text_col))
                weight = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(weight, text, gain[bucket])
                columns = [part.column(0), pa.array(n_words), pa.array(np.bincount(text, minlength=part.num_rows).astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_features", "weight"])

    return text_frame(df, id_col, text_col).mapInArrow(score, f"`{id_col}` long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", coarse: int = COARSE) -> DataFrame:
    """``scored`` (a written table with ``n_words`` and ``score``) with ``rank``: 1, 2, 3... by score descending, id ascending, null if undrawn."""
    spark, may = scored.sparkSession, F.col("n_words") >= least_words
    low, high, n = scored.where(may).agg(F.min("score"), F.max("score"), F.count("*")).first()
    wanted = percent * n // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", undrawn)
    width = (high - low) // coarse + 1
    scored = scored.withColumn("bin", F.when(may, F.floor((F.col("score") - low) / F.lit(width))))
    bins = scored.where(may).groupBy("bin").count().toPandas().sort_values("bin", ascending=False)  # at most ``coarse`` rows
    above = (bins["count"].cumsum() - bins["count"]).to_numpy()
    alive = above < wanted
    offsets = spark.createDataFrame(list(zip(bins["bin"].to_numpy()[alive].tolist(), above[alive].tolist(), strict=True)), "bin long, above long")
    least = int(bins["bin"].to_numpy()[alive].min())

    # exact scores of the bins that reach into the draw; a bin has at most ``width`` of them
    higher = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    exact = scored.where(may & (F.col("bin") >= least)).groupBy("bin", "score").count().join(F.broadcast(offsets), "bin")
    exact = exact.select("score", (F.col("above") + F.coalesce(F.sum("count").over(higher), F.lit(0))).alias("before")).where(F.col("before") < wanted)
    cutoff = exact.agg(F.min("score")).first()[0]

    drawn = may & (F.col("score") >= cutoff)
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    ranked = scored.where(drawn).withColumn("nth", F.row_number().over(within)).join(exact, "score").withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    names = [c for c in scored.columns if c != "bin"]
    return scored.where(~drawn).select(*names, undrawn).unionByName(ranked.select(*names, "rank"))


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_features``, ``weight``, ``score`` and ``rank``, null if it is not drawn.

    Defined cases: null and empty texts have no features, weight 0 and are never drawn; very long texts count whole; a
    null id has the noise of the empty id and comes last among equal scores; rows of one id have the same noise and are
    ranked each, by features and weight where their scores are the same; with no documents that have words enough, or too few for one
    draw, all ranks are null; an empty target has no features; an empty table gives an empty table; other columns are ignored.
    """
    gain = gains(bucket_counts(df, buckets, text_col=text_col), bucket_counts(target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296)))
    path = shared_path(df.sparkSession, "weights")
    weigh(df, gain, id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + noise).write.parquet(path)
    return draw(df.sparkSession.read.parquet(path), percent, least_words, id_col).select(id_col, "n_features", "weight", "score", "rank")
