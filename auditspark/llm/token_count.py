"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are held as one flat array of symbols with the number of the sequence of each. In every
round the lowest-rank pair of each sequence is merged at all its places in all sequences at once; what survives is
counted. A pair of a merged symbol always ranks after the merge that made it (each merge makes a symbol of its own), so
a round does what the queue of the usual algorithm does one place after another.

Defined cases: null and empty text have 0 bytes and 0 tokens; a special string in the text is one token, as by the
tokenizer file's default; very long pre-tokens are merged like others but not kept in the cache; repeated ids and rows
give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from auditspark.llm.common import slices, text_frame, texts_of

#: Fixed: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a worker's cache at most, and the longest that is kept; beyond the first the cache starts anew.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 48
NEVER = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary as arrays: symbols of bytes, sorted keys of pairs, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PATTERN)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the pre-tokens, none of them empty."""
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        found = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), NEVER, dtype=np.int32)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NEVER)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            active = least < NEVER
            if not active.any():
                break
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NEVER))
            # of places that overlap (aaa), the first, third, ... of each run are merged
            new_run = np.r_[True, np.diff(at) != 1]
            run = at[new_run][np.cumsum(new_run) - 1]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(active, sizes)
            keep[at + 1] = False
            np.subtract.at(found, owner[at], 1)
            symbols, owner = symbols[keep], owner[keep]
        return found


@lru_cache(maxsize=2)
def merges(path: str) -> tuple[Merges, dict[str, int]]:
    return Merges(path), {}


def token_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    table, cache = merges(path)
    cut: list[list[str]] = []
    extra = []
    for text in texts:
        parts = table.special.split(text) if table.special else [text]
        extra.append(len(parts) - 1)
        cut.append([t for part in parts for t in table.pattern.findall(part)])
    new = list({t for tokens in cut for t in tokens if t not in cache})
    if len(cache) + len(new) > CACHE_ENTRIES:
        cache.clear()
        new = list({t for tokens in cut for t in tokens})
    own = dict(zip(new, table.counts([t.encode("utf-8", "surrogatepass") for t in new]).tolist(), strict=True)) if new else {}
    cache.update((t, n) for t, n in own.items() if len(t) <= CACHE_LENGTH)
    long = {t: n for t, n in own.items() if len(t) > CACHE_LENGTH}
    get = (lambda t: long[t] if t in long else cache[t]) if long else cache.__getitem__
    return [sum(map(get, tokens)) + n for tokens, n in zip(cut, extra, strict=True)]


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens). A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part, text_col)
                n = token_counts(texts, tokenizer)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return text_frame(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
