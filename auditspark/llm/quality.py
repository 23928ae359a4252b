"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Trusted text is every labelled document of quality 1, whole and without a sample, in whatever characters it is written.
Texts fall into two folds by their hash, and each is scored by the model of the other fold's trusted texts. So a trusted
text is never judged by counts of its own, nor are its copies, and quantiles of trusted texts hold for all others.

N-grams are strings of at most ``ORDER`` characters. Tasks count those of their texts; all else are aggregates and joins
of tables that Spark shards by n-gram or context, and that grow with the corpus: counts of the trusted texts and the
n-grams that texts ask for meet in one table, lower orders follow from it (how many characters stand before each), and
from one character up each order's probability is joined from its context's counts and its suffix's probability.

Of the resulting probabilities those of the most frequent n-grams, at most ``HEAD``, are broadcast, and give each text
the greatest part of its loss. The n-grams of a text beyond them are joined with the sharded rest of the table and summed
by text. As none of these is frequent, no key of that join is hot. Where the line between both lies changes no result.

A text is rejected if its loss lies outside quantiles of the trusted texts of its language. A mean over few characters
varies more, so distances from the language's median count as shrunk by ``sqrt(chars / (chars + SHORT))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint, shared_path, slices

#: Characters of an n-gram.
ORDER = 5
#: N-grams at most whose probabilities are broadcast; the others are joined.
HEAD = 1_000_000
#: Quantiles of trusted texts; how far beyond them, in parts of their distance from the median, a text stays, and how much more the fewer trusted texts there are (by one over the root of their number).
QUANTILES, MARGIN, FEW = (0.005, 0.995), 0.5, 8.0
#: Characters at which a text's distance counts as shrunk by the root of one half.
SHORT = 200
#: Labels, and languages with limits, of more rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 2_000_000
#: Stands before a text ORDER - 1 times: the last code point, which is no character.
START = 0x10FFFF
#: Characters worked on at a time, and distinct n-grams that a task holds before it gives them on.
PIECE, FLUSH = 500_000, 300_000


def trusted(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose label has quality 1, each once however often it is labelled so."""
    good = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("__id")).where("__id is not null").distinct()
    good = F.broadcast(good) if labels.count() <= BROADCAST_ROWS else good
    return documents.join(good, documents[id_col].cast("long") == good["__id"], "left_semi")


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as code points, each after the start, about PIECE at a time: code points, number of the text each n-gram is of, and its hash.

    N-grams are those that end in a character; the i-th one begins at place i of the code points, if its number isn't -1.
    """
    gap = ORDER - 1
    for numbers, joined, lengths in _joined(texts):
        symbols = np.full(int(lengths.sum()) + gap * len(lengths), START, dtype=np.uint32)
        owner = np.full(len(symbols), -1, dtype=np.int64)
        at = np.repeat(np.cumsum(lengths + gap) - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        symbols[at] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner[at] = np.repeat(numbers, lengths)
        for start in range(0, len(symbols) - gap, PIECE):
            part = symbols[start : start + PIECE + gap]
            yield part, owner[start + gap : start + PIECE + gap], _hashes(part)


def _joined(texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """Texts with characters, several at a time: their numbers, their characters and their lengths."""
    numbers, size = [], 0
    for k, text in enumerate(texts):
        if numbers and size + len(text) > PIECE:
            yield np.array(numbers), "".join(texts[i] for i in numbers), np.array([len(texts[i]) for i in numbers])
            numbers, size = [], 0
        if text:
            numbers.append(k)
            size += len(text)
    if numbers:
        yield np.array(numbers), "".join(texts[i] for i in numbers), np.array([len(texts[i]) for i in numbers])


def _hashes(symbols: np.ndarray, step: int = 1) -> np.ndarray:
    """A 64-bit hash of the n-gram that begins at each place, or at every ``step``-th."""
    n = len(symbols) - ORDER + 1
    out = np.full(len(range(0, n, step)), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(ORDER):
        out ^= symbols[k : k + n : step]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def with_hash(grams: DataFrame) -> DataFrame:
    """``(fold, gram, level, log_p)`` with the hash ``h`` instead of the n-gram: what tasks look n-grams of texts up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            hashes = _hashes(symbols, ORDER).view(np.int64) if len(symbols) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes), batch.column(2), batch.column(3)], names=["fold", "h", "level", "log_p"])

    return grams.select("fold", "gram", "level", "log_p").mapInArrow(run, "fold int, h long, level int, log_p double")


class _Counts:
    """Counts of n-grams, by hash."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, symbols: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> None:
        places = np.flatnonzero(owner >= 0)
        keys, first, n = np.unique(hashes[places], return_index=True, return_counts=True)
        begin = places[first]
        self.parts.append((keys, np.stack([symbols[begin + k] for k in range(ORDER)], axis=1), n))
        self.size += len(keys)
        if self.size > FLUSH:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, grams, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
            self.parts = [(keys, grams[first], np.bincount(where, weights=n).astype(np.int64))]
            self.size = len(keys)

    def take(self) -> tuple[list[str], np.ndarray]:
        self.merge()
        _, grams, n = self.parts[0]
        text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.parts, self.size = [], 0
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)], n


def count_ngrams(texts: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``fold``, ``gram`` and its count ``name`` in the texts ``(fold, text)``; not yet summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Counts(), _Counts()]

        def given(k: int) -> pa.RecordBatch:
            grams, n = held[k].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, dtype=np.int32)), pa.array(grams), pa.array(n)], names=["fold", "gram", name])

        for part in (p for batch in batches for p in slices(batch)):
            folds = part.column(0).to_numpy()
            for k in (0, 1):
                for piece in _pieces(part.column(1).filter(pa.array(folds == k)).to_pylist()):
                    held[k].add(*piece)
                    if held[k].size > FLUSH:
                        yield given(k)
        for k in (0, 1):
            if held[k].size:
                yield given(k)

    return texts.select("fold", F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"fold int, gram string, {name} long")


def discounts(m: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts 1 to 4; fixed ones where these are too few to tell."""
    if min(m) == 0:
        return 0.5, 0.75, 0.9
    y = m[0] / (m[0] + 2 * m[1])
    d = [k - (k + 1) * y * m[k] / m[k - 1] for k in (1, 2, 3)]
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in enumerate(d, 1))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """``fold``, ``gram`` and ``n`` (times seen in training, 0 if only asked for) to ``fold``, ``gram`` and its probability ``p``: of its last character after those before."""
    orders = {ORDER: grams.select("fold", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = checkpoint(orders[k + 1].groupBy("fold", F.expr("substring(gram, 2)").alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")))
    counted = None
    for k, rows in orders.items():
        one = rows.where("n > 0").groupBy("fold", F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("m")).withColumn("k", F.lit(k))
        counted = one if counted is None else counted.unionByName(one)
    m = {(r.k, r.fold, r.n): r.m for r in counted.collect()}
    prob = None
    for k in range(1, ORDER + 1):
        cut = F.lit(0.0)
        for side in (0, 1):
            for at, value in enumerate(discounts([m.get((k, side, i), 0) for i in (1, 2, 3, 4)]), 1):
                cut = F.when((F.col("fold") == side) & (F.least("n", F.lit(3)) == at), value).otherwise(cut)
        rows = orders[k].withColumn("cut", cut).withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = rows.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        rows = rows.join(contexts, ["fold", "context"])
        if prob is None:
            seen = [sum(m.get((1, side, i), 0) for i in range(1, 6)) for side in (0, 1)]
            lower = F.when(F.col("fold") == 0, 1.0 / (seen[0] + 1)).otherwise(1.0 / (seen[1] + 1))  # evenly: the characters seen, and all others as one
        else:
            below = prob.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows, lower = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, ["fold", "suffix"]), F.col("lower")
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut") + F.col("left") * lower) / F.col("total")).otherwise(lower)
        prob = rows.select("fold", "gram", p.alias("p"))
    return prob


class Head:
    """Logarithms of the probabilities of frequent n-grams, by fold and hash."""

    def __init__(self, rows: pa.Table):
        self.of = []
        for side in (0, 1):
            own = rows.filter(pa.array(rows["fold"].to_numpy() == side))
            order = np.argsort(own["h"].to_numpy().view(np.uint64))
            self.of.append((own["h"].to_numpy().view(np.uint64)[order], own["log_p"].to_numpy()[order]))

    def scores(self, side: int, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Each text's loss as far as it is known, and the hashes and counts of its n-grams that aren't."""
        keys, logs = self.of[side]
        loss = np.zeros(len(texts))
        left, times = [np.zeros(0, dtype=np.int64)] * len(texts), [np.zeros(0, dtype=np.int64)] * len(texts)
        missing: list[tuple[np.ndarray, np.ndarray]] = []
        for _, owner, hashes in _pieces(texts):
            places = np.flatnonzero(owner >= 0)
            found, where = np.unique(hashes[places], return_inverse=True)
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            known = keys[at] == found if len(keys) else np.zeros(len(found), dtype=bool)
            value = np.where(known, logs[at], 0.0) if len(keys) else np.zeros(len(found))
            loss -= np.bincount(owner[places], weights=value[where], minlength=len(texts))
            if not known.all():
                rest = ~known[where]
                missing.append((owner[places][rest], found[where[rest]]))
        if missing:
            owner, hashes = (np.concatenate(x) for x in zip(*missing, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
            for k, begin, end in zip(*_runs(owner), strict=True):
                own, n = np.unique(hashes[begin:end], return_counts=True)
                left[k], times[k] = own.view(np.int64), n
        return loss, left, times


def _runs(owner: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return owner[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(owner)]


def _threshold(table: DataFrame, most: int) -> tuple[int, bool]:
    """The least level of frequency (eighths of a doubling) that at most ``most`` n-grams reach, and whether all do."""
    levels = sorted(((r.level, r.n) for r in table.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1_000, 0
    for level, n in levels:
        if total + n > most:
            return least, False
        least, total = level, total + n
    return least, True


def losses(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, head: int | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of each row with ``__chars`` and ``__loss``: the mean negative logarithm of a character's probability; null without characters.

    What is given is written to the shared folder. ``head``: n-grams to broadcast at most; bears on speed only.
    """
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    texts = df.select(fold(F.col(text_col)).alias("fold"), F.col(text_col).alias("text"))
    good = trusted(df.select(id_col, F.col(text_col).alias("text")), labels, id_col)
    learned = count_ngrams(good.select((1 - fold(F.col("text"))).alias("fold"), "text"), "n")
    asked = count_ngrams(texts, "m")
    both = learned.withColumn("m", F.lit(0).cast("long")).unionByName(asked.withColumn("n", F.lit(0).cast("long")))
    grams = checkpoint(both.groupBy("fold", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    wanted = grams.where("m > 0").select("fold", "gram", F.floor(F.log2("m") * 8).cast("int").alias("level"))
    table = checkpoint(with_hash(wanted.join(kneser_ney(grams), ["fold", "gram"]).withColumn("log_p", F.log("p"))))
    least, whole = _threshold(table, HEAD if head is None else head)
    shared = spark.sparkContext.broadcast(Head(table.where(F.col("level") >= least).select("fold", "h", "log_p").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for batch in batches for p in slices(batch)):
            side, texts = batch.column(n_out - 1).to_numpy(), [x or "" for x in batch.column(text_at).to_pylist()]
            loss, chars = np.zeros(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            left, times = [None] * len(texts), [None] * len(texts)
            for k in (0, 1):
                own = np.flatnonzero(side == k)
                if len(own):
                    loss[own], a, b = shared.value.scores(k, [texts[i] for i in own])
                    for i, x, y in zip(own.tolist(), a, b, strict=True):
                        left[i], times[i] = x, y
            given = [pa.array(chars), pa.array(loss), pa.array(left, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_out)), *given], names=[*batch.schema.names[:n_out], "__chars", "__sum", "__left", "__times"])

    # the text goes to tasks once, whether or not it is among the columns that come back
    base = df.select(*keep, fold(F.col(text_col)).alias("__fold"), *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    n_out, text_at = len(keep) + 1, keep.index(text_col) if text_col in keep else len(keep) + 1
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n_out]]
    path = shared_path(spark, "losses")
    base.mapInArrow(run, ", ".join([*kinds, "__chars long", "__sum double", "__left array<long>", "__times array<long>"])).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    total = F.col("__sum")
    if not whole:
        rest = table.where(F.col("level") < least).select(F.col("fold").alias("__fold"), F.col("h").alias("__h"), "log_p")
        open_ = rows.where(F.size("__left") > 0).select("__row", "__fold", F.explode(F.arrays_zip("__left", "__times")).alias("x")).select("__row", "__fold", F.col("x.__left").alias("__h"), F.col("x.__times").alias("times"))
        sums = open_.join(rest, ["__fold", "__h"]).groupBy("__row").agg(F.sum(-F.col("log_p") * F.col("times")).alias("__rest"))
        rows, total = rows.join(sums, "__row", "left"), total + F.coalesce("__rest", F.lit(0.0))
    return rows.select(*keep, "__chars", F.when(F.col("__chars") > 0, total / F.col("__chars")).alias("__loss"))


def _language(df: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in df.columns else F.lit("")


def _shrunk(chars: Column) -> Column:
    return F.sqrt(chars / (chars + SHORT))


def bounds(rows: DataFrame) -> DataFrame:
    """``lang``, ``mid``, ``low`` and ``high`` of trusted texts ``(lang, chars, loss)``: the median, and how far below and above it a text may be."""
    middle = rows.groupBy("lang").agg(F.percentile_approx("loss", 0.5, 20_000).alias("mid"), F.count("*").alias("n"))
    apart = rows.join(F.broadcast(middle) if middle.count() <= BROADCAST_ROWS else middle, "lang").withColumn("z", (F.col("loss") - F.col("mid")) * _shrunk(F.col("chars")))
    edges = apart.groupBy("lang", "mid", "n").agg(F.percentile_approx("z", list(QUANTILES), 20_000).alias("q"))
    wide = 1 + MARGIN * (1 + FEW / F.sqrt("n"))
    return edges.select("lang", "mid", (F.least(F.col("q")[0], F.lit(0.0)) * wide).alias("low"), (F.greatest(F.col("q")[1], F.lit(0.0)) * wide).alias("high"))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, head: int | None = None) -> DataFrame:
    """The columns ``keep`` with ``__loss``, ``__lowest`` and ``__highest`` (null without limits) and ``__kept``."""
    rows = losses(df.withColumn("__lang", _language(df)), labels, id_col, text_col, [*(keep or df.columns), "__lang"], head)
    good = trusted(rows.where("__loss is not null"), labels, id_col).select(F.col("__lang").alias("lang"), F.col("__chars").alias("chars"), F.col("__loss").alias("loss"))
    limits = checkpoint(bounds(good).select(F.col("lang").alias("__lang"), F.col("mid").alias("__mid"), F.col("low").alias("__low"), F.col("high").alias("__high")))
    rows = rows.join(F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits, "__lang", "left")
    low, high = (F.col("__mid") + F.col(c) / _shrunk(F.col("__chars")) for c in ("__low", "__high"))
    rows = rows.withColumns({"__lowest": F.when(F.col("__chars") > 0, low), "__highest": F.when(F.col("__chars") > 0, high)})
    return rows.withColumn("__kept", F.coalesce(F.col("__loss").between(F.col("__lowest"), F.col("__highest")), F.lit(True)))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int | None = None) -> DataFrame:
    """One row per row: the id, ``perplexity`` (per character), ``lowest`` and ``highest`` that are kept, and ``kept``.

    Defined cases: null and empty texts have no perplexity and are kept, as nothing speaks against them; a null language
    is one of its own; in a language without trusted text nothing is rejected, and has no limits; a perplexity equal to a
    limit is kept; without trusted text of the other fold all characters are equally likely; a null id is scored, but
    never trusted; an id labelled both ways is trusted; very long texts are scored whole; repeated rows give one row each
    (and count each in training); an empty table gives an empty table; other columns are ignored.
    """
    base = df.select(F.col(id_col).cast("long").alias(id_col), _language(df).alias("lang"), F.col(text_col).alias(text_col))
    rows = judged(base, labels, id_col, text_col, [id_col], head)
    return rows.select(id_col, *(F.exp(a).alias(b) for a, b in (("__loss", "perplexity"), ("__lowest", "lowest"), ("__highest", "highest"))), F.col("__kept").alias("kept"))


def drop_low_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int | None = None) -> DataFrame:
    """The rows of ``df`` with its columns whose perplexity is within the limits of their language, by the rules of ``score_quality``."""
    return judged(df, labels, id_col, text_col, df.columns, head).where("__kept").select(*df.columns)
