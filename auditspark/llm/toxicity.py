"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels are of documents, the field needs labels of words: a lexicon is chosen greedily from words and their first
letters such that it covers the toxic documents and is all but absent from the others; words of toxic documents that
it matches are labelled 1, all else 0. The field (label bias, word and prefix weights, label transitions) is trained on
windows of these words. To score a text, forward and backward messages run over the whole chain; where no word has
weights of its own the chain is a power of one matrix and is skipped in closed form, which gives the same marginals as
a step for each word. A document's score is a logistic function of its highest marginal, their sum and its length; runs
of words with a marginal of one half or more are the offending spans.

Training reads a bounded sample: at most ``SAMPLE`` labelled documents of either label, in the order of a hash.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import slices, text_frame, texts_of

WORD = re.compile(r"\w+")
#: Labelled documents of either label for training at most, and words of a training window.
SAMPLE, WINDOW = 2_500, 15
#: Letters of the prefixes that are features, entries of the lexicon at most, and distinct words a worker keeps.
PREFIXES, LEXICON, CACHE = (3, 4, 5), 400, 250_000
#: Distinct words that training keeps on the driver.
TRAIN_CACHE = 20_000


def features(word: str) -> list[str]:
    word = word.lower()
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Field:
    """Weights of label 1 against label 0 by feature, the transitions between labels, and the document's logistic weights."""

    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.8, 0.0, 0.0]))
    cache: dict[str, float | None] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emission(self, word: str) -> float | None:
        """Weight of label 1 of a word that has weights of its own, else None."""
        known = [self.weights[f] for f in features(word) if f in self.weights]
        return self.bias + sum(known) if known else None

    def marginals(self, text: str) -> tuple[int, list[int], np.ndarray]:
        """Number of words, the places of words that have weights of their own, and their marginals of label 1."""
        words = WORD.findall(text)
        cache = self.cache
        if new := [w for w in set(words) if w not in cache]:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = set(words)
            cache.update((w, self.emission(w)) for w in new)
        found = [(i, e) for i, w in enumerate(words) if (e := cache[w]) is not None]
        at = [i for i, _ in found]
        return len(words), at, self._chain(len(words), at, np.array([e for _, e in found]))

    def _chain(self, n: int, at: list[int], emissions: np.ndarray) -> np.ndarray:
        if not at:
            return np.zeros(0)
        step = np.exp(self.transitions) * np.array([1.0, math.exp(self.bias)])  # to a word without weights
        power = _Powers(step)
        move = np.exp(self.transitions)
        emit = np.stack([np.ones(len(at)), np.exp(np.clip(emissions, -50, 50))], axis=1)
        forward = np.zeros((len(at), 2))
        state = np.array([1.0, math.exp(self.bias)]) @ power(at[0] - 1) if at[0] else None
        for k in range(len(at)):
            if k:
                state = forward[k - 1] @ power(at[k] - at[k - 1] - 1)
            forward[k] = emit[k] if state is None else (state @ move) * emit[k]
            forward[k] /= forward[k].sum()
        out = np.zeros(len(at))
        back = power(n - 1 - at[-1]) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            if k < len(at) - 1:
                back = power(at[k + 1] - at[k] - 1) @ (move @ (emit[k + 1] * back))
            back = back / back.sum()
            both = forward[k] * back
            out[k] = both[1] / both.sum()
        return out

    def evidence(self, n: int, marginals: np.ndarray) -> np.ndarray:
        if not len(marginals):
            return np.array([1.0, -8.0, 0.0, 0.0])
        top = float(np.clip(marginals.max(), 1e-6, 1 - 1e-6))
        return np.array([1.0, math.log(top / (1 - top)), math.log1p(marginals.sum()), marginals.sum() / math.sqrt(n)])

    def score(self, text: str) -> float:
        n, _, marginals = self.marginals(text)
        return 1 / (1 + math.exp(-float(np.clip(self.evidence(n, marginals) @ self.document, -30, 30))))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Offsets (code points) of runs of words with a marginal of one half or more."""
        _, at, marginals = self.marginals(text)
        bad = {i for i, p in zip(at, marginals, strict=True) if p >= 0.5}
        out: list[tuple[int, int]] = []
        last = -2
        for i, m in enumerate(WORD.finditer(text) if bad else ()):
            if i in bad:
                out = [*out[:-1], (out[-1][0], m.end())] if last == i - 1 else [*out, (m.start(), m.end())]
                last = i
        return out


class _Powers:
    """Powers of a positive 2 x 2 matrix, scaled by its larger eigenvalue."""

    def __init__(self, m: np.ndarray):
        half, det = (m[0, 0] + m[1, 1]) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
        root = math.sqrt(max(half * half - det, 1e-300))
        self.large, self.small = half + root, half - root
        self.one = (m - self.small * np.eye(2)) / (self.large - self.small)
        self.two = np.eye(2) - self.one

    def __call__(self, k: int) -> np.ndarray:
        return self.one + self.two * (self.small / self.large) ** k if k else np.eye(2)


def _own(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text)) for f in features(w)}


class Texts(Sequence):
    """Texts of an Arrow column in an order, of which one at a time is a Python object."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        self.column, self.order = column, order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> str:
        return self.column[int(self.order[i])].as_py()


def lexicon(texts: Sequence[str], toxic: np.ndarray) -> set[str]:
    """Features that cover the toxic documents and are all but absent from the others, chosen one by one."""
    clean, bad = Counter(), Counter()
    for i in np.flatnonzero(toxic).tolist():
        bad.update(_own(texts[i]))
    bad = {f: n for f, n in bad.items() if n >= 2}
    for i in np.flatnonzero(~toxic).tolist():  # what few or no toxic documents have is never asked
        clean.update(f for f in _own(texts[i]) if f in bad)
    n_bad, n_clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    # rarer than a third of a per cent among others, and far more frequent among toxic documents
    able = {f for f, n in bad.items() if clean[f] / n_clean <= 0.003 and n / n_bad >= 12 * (clean[f] + 0.5) / n_clean}
    del bad
    own = {i: _own(texts[i]) & able for i in np.flatnonzero(toxic).tolist()}
    has: dict[str, list[int]] = {f: [] for f in able}
    for i, found in own.items():
        for f in found:
            has[f].append(i)
    open_docs, chosen = set(np.flatnonzero(toxic).tolist()), set()
    gain = {f: len(x) for f, x in has.items()}
    least = max(2, round(0.004 * n_bad))
    while open_docs and len(chosen) < LEXICON and gain:
        best = max(gain, key=lambda f: (gain[f] - 3 * clean[f] * n_bad / n_clean, not f.endswith("*"), len(f), f))
        if gain[best] < least:
            break
        chosen.add(best)
        for i in has[best]:
            if i in open_docs:
                open_docs.discard(i)
                for f in own[i]:
                    if f in gain:
                        gain[f] -= 1
        del gain[best]
    # what covers as many documents as a chosen entry, and as purely, names the same kind of word
    chosen |= {f for f in able if clean[f] == 0 and len(has[f]) >= max(8, 0.03 * n_bad)}
    return chosen


def train(texts: Sequence[str], toxic: np.ndarray, rounds: int = 120, seed: int = 7) -> Field:
    """A field from whole texts and their labels. Without labels of both kinds every text has a low score.

    It runs on the driver, so of the texts' words only those with features of the field are kept, and windows are arrays.
    """
    model = Field()
    toxic = np.asarray(toxic, dtype=bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return model
    lex = lexicon(texts, toxic)
    index: dict[str, int] = {}
    for i in np.flatnonzero(toxic).tolist():
        for w in sorted(set(WORD.findall(texts[i]))):
            if any(f in lex for f in features(w)):
                for f in features(w):
                    index.setdefault(f, len(index))
    ids: dict[str, list[int]] = {}
    known: set[str] = set()
    rng = np.random.default_rng(seed)
    cells, feats, labels, lengths = array("q"), array("q"), bytearray(), array("q")
    for text, y in zip(texts, toxic, strict=True):
        words = WORD.findall(text)
        for w in set(words) - ids.keys():
            if found := [index[f] for f in features(w) if f in index]:
                ids[w] = found
                if any(f in lex for f in features(w)):
                    known.add(w)
        places = [i for i, w in enumerate(words) if w in ids]
        places += rng.integers(0, len(words), size=3).tolist() if words else []
        for i in places:
            start = max(0, min(i - WINDOW // 2, len(words) - WINDOW))
            part = words[start : start + WINDOW]
            for c, w in enumerate(part, len(lengths) * WINDOW):
                if w in ids:
                    feats.extend(ids[w])
                    cells.extend([c] * len(ids[w]))
            labels += bytes(bool(y) and w in known for w in part) + bytes(WINDOW - len(part))
            lengths.append(len(part))
    if not lengths:  # no text has a word
        return model
    n, y = len(lengths), np.frombuffer(labels, dtype=np.int8).reshape(-1, WINDOW)
    real = np.arange(WINDOW) < np.frombuffer(lengths, dtype=np.int64)[:, None]
    cell, feat = np.frombuffer(cells, dtype=np.int64), np.frombuffer(feats, dtype=np.int64)
    both = real[:, 1:] & real[:, :-1]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
    w, b, t = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    moments = [np.zeros(len(index) + 5), np.zeros(len(index) + 5)]
    for step in range(1, rounds + 1):
        e = b + np.bincount(cell, weights=w[feat], minlength=n * WINDOW).reshape(n, WINDOW)
        p, pair = _expect(e, t, real)
        miss = np.where(real, p - y, 0.0)
        grad = np.r_[np.bincount(feat, weights=miss.ravel()[cell], minlength=len(index)), miss.sum(), (pair - seen).ravel()] / n
        grad[: len(index)] += 1e-5 * w
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = 0.15 * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, b, t = w - move[: len(index)], b - move[len(index)], t - move[len(index) + 1 :].reshape(2, 2)
    model.bias, model.transitions = float(b), t - t[0, 0]
    model.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
    evidence = []
    for text in texts:
        n, _, m = model.marginals(text)
        evidence.append(model.evidence(n, m))
        if len(model.cache) > TRAIN_CACHE:
            model.cache.clear()
    model.cache.clear()
    model.document = _logistic(np.stack(evidence), toxic.astype(float))
    return model


def _expect(e: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 and the sum of the pairwise marginals, over windows of which the last cells may be unused."""
    n, width = e.shape
    emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    move = np.exp(t)
    forward, back = np.zeros((width, n, 2)), np.ones((width, n, 2))
    forward[0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, width):
        now = (forward[k - 1] @ move) * emit[:, k]
        forward[k] = np.where(real[:, k, None], now / now.sum(axis=1, keepdims=True), forward[k - 1])
    pair = np.zeros((2, 2))
    for k in range(width - 2, -1, -1):
        right = emit[:, k + 1] * back[k + 1]
        now = right @ move.T
        back[k] = np.where(real[:, k + 1, None], now / now.sum(axis=1, keepdims=True), back[k + 1])
        both = forward[k][:, :, None] * move[None] * right[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pair += both[real[:, k + 1]].sum(axis=0)
    p = forward * back
    return (p[:, :, 1] / p.sum(axis=2)).T, pair


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression with equal weight of either label, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.5 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5)) == 0


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Broadcast:
    """Trains on at most ``sample`` labelled documents of either label that aren't held out, and broadcasts the field."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).dropDuplicates(["id"])
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.min(F.struct("id", "toxic")).alias("one"))
    rows = rows.select("one.id", "one.toxic", "text").toArrow()
    order = pc.sort_indices(rows, [("id", "ascending"), ("text", "ascending")]).to_numpy()
    model = train(Texts(rows["text"], order), rows["toxic"].to_numpy()[order] == 1)
    return documents.sparkSession.sparkContext.broadcast(model)


def score_toxicity(df: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``held_out``, ``score``, ``predicted`` and ``spans`` (offsets of offending words in the original).

    Defined cases: null, empty and wordless texts have the score of a text without any known word; very long texts are
    scored whole; a null id counts as not held out; repeated rows give one row each; an empty table gives an empty table;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = model.value
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part, text_col)
                scores = [field_.score(t) for t in texts]
                spans = [[{"start": a, "end": b} for a, b in field_.spans(t)] if s >= 0.5 else [] for t, s in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, SPANS)], names=[id_col, "held_out", "score", "predicted", "spans"])

    base = text_frame(df, id_col, text_col).select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_col)
    return base.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def drop_toxic(df: DataFrame, model: Broadcast, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with its columns whose text scores below one half; null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([model.value.score(t) < 0.5 for t in texts_of(part, text_col)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
