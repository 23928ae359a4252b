"""SentencePiece encoding and decoding by one pass of a Viterbi search over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each position the output links give every piece that ends there, and each relaxes
the best path to that position from the one where it begins. For a unigram model a path's score is the sum of its
pieces' scores. For a BPE model the best path is the one that the merges give: a piece may follow another if merging
their joined text gives these two back, exactly one piece does so at each position, and such pairs make the whole
sequence the one that merging the whole text gives; so the transition scores are 0 for such pairs and minus infinity
for others. Results are those of the library.

Words repeat, so each distinct run of blanks and the letters after it is searched once and kept in a bounded cache. This
changes nothing: a text is cut only where no piece of the vocabulary goes across.

Defined cases: null and empty texts have no pieces and decode to the empty text; characters outside the vocabulary are
bytes (or the unknown piece, if the model has no byte pieces); very long words are searched in one pass like others but
not kept; repeated rows give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from auditspark.llm.common import slices, text_frame, texts_of

#: Distinct words and pairs of pieces that a worker keeps at most, and the longest word that is kept.
CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 250_000, 300_000, 48
BLANK = "▁"


class Pieces:
    """A model file's pieces as an automaton, with what is known of words and pairs so far."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {texts[i]: i for i in usual}
        self.score = [model.get_score(i) for i in range(n)]
        self.texts, self.lengths = texts, [len(t) for t in texts]
        self.unknown = model.unk_id()
        self.byte = {int(texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.decoded = [of_byte[i] if i in of_byte else b"" if model.is_control(i) else texts[i].replace(BLANK, " ").encode() for i in range(n)]
        if self.unknown >= 0:
            self.decoded[self.unknown] = " ⁇ ".encode()
        #: A model whose scores are ranks in whole numbers was made by merging.
        self.by_merging = all(self.score[i] == round(self.score[i]) for i in usual)
        # how the model writes blanks, told from what it makes of a short text
        self.prefix = model.encode("a", out_type=str)[:1] != ["a"] if "a" in self.ids else True
        self.squeeze = model.encode("a  a", out_type=str) == model.encode("a a", out_type=str)
        #: A character that is no piece.
        self.outside = re.compile("([^" + "".join(re.escape(t) for t in self.ids if len(t) == 1) + "])", re.S)
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        inner = any(BLANK in t.lstrip(BLANK) for t in self.ids)
        lines = any("\n" in t and len(t) > 1 for t in self.ids)
        # without blanks inside or after letters in any piece, words begin at blanks; likewise lines at line feeds
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]*" if lines else f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+", re.S) if not inner else re.compile(".+", re.S)
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.own_steps: dict[int, tuple | None] = {}

    def prepare(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return ((" " if self.prefix and text else "") + text).replace(" ", BLANK)

    def steps(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """Merging a piece's own text: the score of each merge and the first and last symbol before it and after; None if that doesn't give the piece."""
        if piece in self.own_steps:
            return self.own_steps[piece]
        text = self.texts[piece]
        parts, rank, scores, first, last = list(text), self.score, [], [text[0]], [text[-1]]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and rank[k] > best:
                    best, at = rank[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        self.own_steps[piece] = (scores + [-np.inf], first, last) if len(parts) == 1 else None
        return self.own_steps[piece]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two.

        Merges within either piece go on as they do alone, those with the higher score first and the left of equals
        first; what is asked is whether a merge across would ever come first.
        """
        a, b = self.steps(left), self.steps(right)
        if a is None or b is None:
            return False
        (scores_a, _, ends), (scores_b, begins, _) = a, b
        i = j = 0
        while True:
            k = self.ids.get(ends[i] + begins[j])
            if k is not None and self.score[k] > scores_a[i] and self.score[k] >= scores_b[j]:
                return False
            if scores_a[i] >= scores_b[j]:
                if scores_a[i] == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def search(self, word: str) -> list[int]:
        """Ids of the best path through a word; characters without a piece stand alone."""
        if self.outside.search(word):
            out: list[int] = []
            for part in self.outside.split(word):
                if part:
                    out += self._path(part) if not self.outside.match(part) else self._spelled(part)
            return out
        return self._path(word)

    def _path(self, word: str) -> list[int]:
        n = len(word)
        last = [-1] * (n + 1)  # the piece that ends at a position on its best path
        if self.by_merging:
            pairs, lengths, many = self.pairs, self.lengths, len(self.score)
            for end, (piece, length) in self.automaton.iter(word):
                if last[end + 1] >= 0:
                    continue
                j = end + 1 - length
                if j:
                    key = last[j] * many + piece
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) >= CACHE_PAIRS:
                            pairs.clear()
                        good = pairs[key] = self.may_follow(last[j], piece)
                else:
                    good = self.steps(piece) is not None
                if good:
                    last[end + 1] = piece
        else:
            lengths = self.lengths
            best = [0.0] + [-np.inf] * n
            for end, (piece, length) in self.automaton.iter(word):
                score = best[end + 1 - length] + self.score[piece]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, piece
        out: list[int] = []
        while n:
            out.append(last[n])
            n -= lengths[last[n]]
        out.reverse()
        return out

    def _spelled(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary."""
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def encode(self, text: str) -> list[int]:
        words = self.cut.findall(self.prepare(text))
        known = self.words
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.search(w) if w else []
        out: list[int] = []
        for w in words:
            out += known[w]
        for w in new:
            if len(w) > CACHE_LENGTH:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``ids``, ``n_pieces``, and ``round_trip``, whether decoding the ids gives the text back. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in slices(batch, 64):
                texts = texts_of(part, text_col)
                ids = [own.encode(t) for t in texts]
                same = [own.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=[id_col, "ids", "n_pieces", "round_trip"])

    return text_frame(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>, n_pieces long, round_trip boolean")


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and the ``text`` of its ids; null ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pieces(model).decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(df[id_col].cast("long").alias(id_col), df[ids_col].cast("array<int>").alias(ids_col)).mapInArrow(run, f"`{id_col}` long, text string")
