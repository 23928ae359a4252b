"""Phrase collocation mining by contiguous pattern growth.

1. Words are counted per language, added up in each task before the shuffle.
2. Frequent words are the prefixes. For each of their occurrences the words that follow in the same piece are projected;
   equal projections are added up in chunks, and all of a chunk for one prefix make one row.
3. Each prefix is one task's group: its projections lie in one array, occurrences are pointers into it with weights, and the
   prefix is extended to the right depth-first, each frequent extension with the pointers of its own occurrences.
4. Counts of phrases meet by equality joins for the scores of cuts.

A prefix with more than ``GROUP`` occurrences is divided by a hash of what follows, so that no group is larger and equal
phrases of full length stay together; its shorter phrases are added up afterwards. Which words are frequent, and into how
many groups they are divided, is told to the tasks by a table of ``SLOTS`` bytes, by hash: words that share a slot only make
work, they change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, group_starts, slices, whole_groups

#: Words of a phrase at most, its least count, percent of a phrase's count at which a longer one takes its place, phrases of a language.
WORDS, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Bytes of text that are projected at a time, occurrences in a group, slots of the table of frequent words, parts in which a language's best are found.
CHUNK, GROUP, SLOTS, PARTS = 8_000_000, 200_000, 1 << 22, 64
#: Fixed: what a byte becomes. A-Z to lower case, the ends of pieces to stops, tabs to blanks.
BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
STOP = b"."


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of the texts, and the number of the word at each place; the stop, number -1, ends every piece."""
    raw = np.frombuffer(STOP.join([*texts, b""]).translate(BYTES).replace(STOP, b" . "), dtype=np.uint8)
    blank = raw == 32
    raw = raw[~(blank & np.r_[True, blank[:-1]])]  # each word has one blank after it
    ends = np.flatnonzero(raw == 32) + 1
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    names, at = pc.utf8_rtrim(words.dictionary.cast(pa.string()), characters=" "), words.indices.to_numpy().astype(np.int64)
    stop = names.index(".").as_py()
    return names, np.where(at == stop, -1, at)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Chunks of about ``size`` bytes: for each of its languages the distinct words and the number of the word at each place."""
    texts, held = {}, 0
    for batch in batches:
        for part in slices(batch, 64):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
                held += len(texts[lang][-1])
                if held >= size:
                    for own in sorted(texts):
                        yield own, *numbered(texts[own])
                    texts, held = {}, 0
    for own in sorted(texts):
        yield own, *numbered(texts[own])


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (one word) and ``f``; a null phrase has the number of all words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, at in _chunks(batches, CHUNK):
            n = np.bincount(at[at >= 0], minlength=len(names))
            used = np.flatnonzero(n)
            words = pa.concat_arrays([names.take(pa.array(used)), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.r_[n[used], n.sum()])], names=["lang", "phrase", "f"])

    return texts.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def slot_table(words: DataFrame, least: int, group: int, slots: int = SLOTS) -> np.ndarray:
    """By hash of language and word: 0 if no such word is frequent, else 1 and how often the number of its groups is doubled."""
    doubled = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("f") / F.lit(float(group))))).cast("int")
    slot = F.pmod(F.xxhash64("lang", "phrase"), F.lit(slots)).cast("int")
    found = words.where(F.col("phrase").isNotNull() & (F.col("f") >= least)).groupBy(slot.alias("slot")).agg((F.max(doubled) + 1).alias("v")).toPandas()  # at most ``slots`` rows
    table = np.zeros(slots, dtype=np.uint8)
    table[found["slot"]] = found["v"]
    return table


def word_hashes(lang: str, names: pa.Array) -> np.ndarray:
    """As Spark's ``xxhash64`` of both columns, unsigned."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))


def project(names: pa.Array, at: np.ndarray, levels: np.ndarray, hashes: np.ndarray, words: int) -> pa.RecordBatch:
    """A row per prefix, and part of it if its level is over 1: ``prefix``, ``level``, ``part``, ``follow`` and ``times``.

    ``follow`` has the ``words`` - 1 words after each distinct occurrence, between blanks, empty ones after a stop or a
    word that isn't frequent; ``times`` how often it occurs, as 32-bit numbers.
    """
    frequent = np.flatnonzero(levels)
    number = np.zeros(len(names) + 1, dtype=np.int64)  # the last is the stop's
    number[frequent] = np.arange(1, len(frequent) + 1)
    place = np.r_[number[at], np.zeros(words, dtype=np.int64)]
    starts = np.flatnonzero((place[:-1] > 0) & (place[1:] > 0))
    key, columns, on = place[starts], [place[starts]], True
    for k in range(1, words):
        on = on & (place[starts + k] > 0)
        columns.append(np.where(on, place[starts + k], 0))
        if len(key) and key.max() > (1 << 62) // (len(frequent) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * (len(frequent) + 1) + columns[-1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    prefix, *follow = (c[first] for c in columns)
    level = np.r_[np.uint8(0), levels[frequent]][prefix].astype(np.int64)
    mixed = np.zeros(len(prefix), dtype=np.uint64)
    for c in follow:
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.uint64(0), hashes[frequent]][c]
    part = (mixed >> np.uint64(20)).astype(np.int64) & ((1 << np.maximum(level - 1, 0)) - 1)
    order = np.lexsort((part, prefix))
    prefix, part, level, n = prefix[order], part[order], level[order], n[order]
    new = np.flatnonzero(np.r_[True, (np.diff(prefix) != 0) | (np.diff(part) != 0)]) if len(order) else order
    bounds = np.r_[new, len(order)].astype(np.int32)
    known = pa.concat_arrays([pa.array([""], pa.string()), names.take(pa.array(frequent))])
    after = known.take(pa.array(follow[0][order]))
    for c in follow[1:]:
        after = pc.binary_join_element_wise(after, known.take(pa.array(c[order])), " ")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), after), " ")
    times = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(4 * bounds), pa.py_buffer(n.astype("<u4"))])
    return pa.RecordBatch.from_arrays([known.take(pa.array(prefix[new])), pa.array(level[new], pa.int32()), pa.array(part[new]), joined, times], names=["prefix", "level", "part", "follow", "times"])


def projections(texts: DataFrame, table: np.ndarray, words: int) -> DataFrame:
    """``lang`` and the rows of ``project`` of each chunk."""
    sent = texts.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, dtype=np.uint8)
        for lang, names, at in _chunks(batches, CHUNK):
            hashes = word_hashes(lang, names)
            levels = np.where(np.arange(len(names)) == names.index(".").as_py(), 0, table[hashes % np.uint64(len(table))])
            rows = project(names, at, levels, hashes, words)
            for k in range(0, rows.num_rows, 10_000):
                some = rows.slice(k, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * some.num_rows, pa.string()), *some.columns], names=["lang", *some.schema.names])

    return texts.mapInArrow(run, "lang string, prefix string, level int, part long, follow string, times binary")


class Growth:
    """Growth of the phrases of one prefix: ``found`` has (words after the prefix, count). An occurrence is a pointer to what follows it; -1 is nothing."""

    def __init__(self, after: np.ndarray, least: int, words: int, whole: bool):
        self.after, self.least, self.words, self.whole, self.found = after, least, words, whole, []

    def extend(self, phrase: tuple[int, ...], at: np.ndarray, times: np.ndarray) -> None:
        """All frequent phrases that begin with ``phrase``, whose occurrences are followed by what lies at the pointers ``at``."""
        follow = self.after[at]
        order = np.argsort(follow, kind="stable")
        order = order[np.searchsorted(follow[order], 0) :]
        if not len(order):
            return
        ids = follow[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        counts = np.add.reduceat(times[order], starts)
        last = len(phrase) + 2 == self.words
        # a group with only some of the prefix's occurrences has all of a phrase of full length, but only some of a shorter one
        shown = np.flatnonzero(counts >= (self.least if last or self.whole else 1))
        words, n = ids[starts[shown]].tolist(), counts[shown].tolist()
        self.found += [((*phrase, w), c) for w, c in zip(words, n, strict=True)]
        if not last:
            ends = np.r_[starts[1:], len(order)]
            for k, w, c in zip(shown.tolist(), words, n, strict=True):
                if c >= self.least:
                    own = order[starts[k] : ends[k]]
                    self.extend((*phrase, w), at[own] + 1, times[own])


def grow(projected: DataFrame, least: int, words: int) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``f`` of frequent phrases of two words and more: a group for each prefix, or part of one."""
    keys = ["lang", "prefix", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            tokens = pc.split_pattern(table["follow"].combine_chunks(), " ")
            edges = np.r_[starts, table.num_rows]
            edges = (tokens.offsets.to_numpy()[edges] - tokens.offsets.to_numpy()[0]) // (words - 1)
            coded = tokens.flatten().dictionary_encode()
            names, after = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            after = np.where(after == (names.index("") if "" in names else -1), -1, after)
            times = np.frombuffer(b"".join(table["times"].to_pylist()), dtype="<u4").astype(np.int64)
            langs, phrases, sizes, counts = [], [], [], []
            lang, prefix, level = (table[c].take(pa.array(starts)).to_pylist() for c in ("lang", "prefix", "level"))
            for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
                growth = Growth(after, least, words, level[k] == 1)
                growth.extend((), np.arange(a, b) * (words - 1), times[a:b])
                for phrase, n in growth.found:
                    phrases.append(" ".join([prefix[k], *(names[w] for w in phrase)]))
                    sizes.append(len(phrase) + 1)
                    counts.append(n)
                langs += [lang[k]] * len(growth.found)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"])

    dealt = projected.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _run(ws: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(ws, first, n), " ")


def lowest_cuts(known: DataFrame) -> DataFrame:
    """Phrases of two words and more of ``known`` with ``a``, ``l``, ``r`` and ``score`` of the cut that scores lowest."""
    ws = F.split("phrase", " ", -1)
    cuts = known.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", _run(ws, F.lit(1), F.col("k")).alias("left"), _run(ws, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(n)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}  # exact: products have up to 38 digits
    upper, lower = wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"]
    cuts = cuts.withColumn("upper", upper).withColumn("lower", lower).withColumn("score", F.expr("upper div lower"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_covered(scored: DataFrame, known: DataFrame, cover: int) -> DataFrame:
    """Phrases that no longer one holds whose count is ``cover`` percent of theirs or more."""
    ws = F.split("phrase", " ", -1)
    spans = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> struct(i AS first, n AS n))))")
    inner = known.where("words > 2").withColumn("span", F.explode(spans)).select("lang", _run(ws, F.col("span.first"), F.col("span.n")).alias("phrase"), "f")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")


def collocations(df: DataFrame, words: int = WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP, group: int = GROUP, slots: int = SLOTS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Defined cases: null and empty texts have no words; a null language is ``und``, together with rows that are so labelled;
    repeated rows count each; very long texts and words count whole; equal scores are ordered by count and phrase; languages
    without a frequent phrase and an empty table have no rows; other columns are ignored. Counts up to 10^16 are exact;
    beyond that the query fails rather than give a wrong score.
    """
    if words < 2:
        raise ValueError("phrases have two words at least")
    texts = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = checkpoint(word_counts(texts).where(F.col("phrase").isNull() | (F.col("f") >= least)))
    grown = grow(projections(texts, slot_table(counted, least, group, slots), words), least, words)
    single = counted.where(F.col("phrase").isNotNull()).select("lang", "phrase", F.lit(1).alias("words"), "f")
    known = checkpoint(single.unionByName(grown))
    left = not_covered(lowest_cuts(known), known, cover)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # the best of each part of a language first, so that no task ranks all of its phrases
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counted.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
