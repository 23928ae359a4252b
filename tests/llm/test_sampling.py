"""Packing, phrase mining and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from auditspark.llm import importance, packing, phrases, queries
from auditspark.llm.common import table
from tests.llm.odd_texts import ODD, empty_frame, odd_frame
from tests.oracle import connect, difference

PATH = public_tokenizers.path(queries.WORD_BPE)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- packing


def brute_pieces(rows, capacity=4096):
    found, tokenizer = Counter(), Tokenizer.from_file(PATH)
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            found[doc, i // capacity, i, len(part), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in part))] += 1
    return found


def sequences(rows, capacity=4096):
    """Sequences, after a check that each is gapless from 0 and within the capacity."""
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_packed_pieces_are_those_of_the_library(spark, sf_dir):
    got = queries.op11_best_fit_packing(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows)
    assert sequences(got) <= 1.01 * sum(r.length for r in got) / 4096 + 1


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing_of_odd_texts(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    got = packing.pack_documents(odd_frame(spark), PATH, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(ODD, capacity)
    sequences(got, capacity)


def test_packing_of_nothing(spark):
    df = packing.pack_documents(empty_frame(spark), PATH)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and df.count() == 0


def test_ids_of_chunks_are_those_of_texts():
    texts = ["It's THE end.  The end,the end... x<|endoftext|>. á A̱ H̱. café; Ω 12,345: don't I'd. 's 'LL\tno\x0bn b 　 wide\x85line", "word$$$ two,&&& $$$ WORD!! Ünï.. ù̀ ÀÉ été İx ΑΣ Ὀδ ЖЁ ŉ ĳ ǆ ԛ ՙա ß ŒŸ x<|endoftext|> <|endoftext|>. a|> b.'s c.' d-- e...f (g). h)(", "İstanbul. ẞ ǅ; ﬁne, é.", "", " ", "\n.\n", "a" * 3000, "日本語。\U0001f600 x̸"]
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    encoder, tokenizer = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(4):
        texts = [f"word{k} Some, other-words and{chr(97 + k)} more.", "", f"{k} end"]
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def filled(plan, lengths, counts, capacity):
    """Tokens of each sequence, after a check that every piece is placed once, at the end of what lies before it."""
    fill, ranks = [[] for _ in range(plan.sequences)], {n: [] for n in lengths.tolist()}
    for length, rank, n, first, many, offset in plan.rows:
        ranks[length] += range(rank, rank + n)
        for j in range(n):
            fill[first + j % many].append((offset + j // many * length, length))
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    for parts in fill:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS", 60)
    rng, capacity = np.random.default_rng(seed), [64, 100, 4096][seed % 3]
    lengths = np.unique(rng.integers(1, capacity + 1, rng.integers(1, 80)))
    counts = rng.integers(1, 30, len(lengths))
    filled(packing.pack(lengths, counts, capacity), lengths, counts, capacity)


def test_the_linear_program_beats_best_fit_alone():
    """Pieces of two fifths and three tenths of a sequence: best fit pairs the longer ones, the program mixes."""
    lengths, counts = np.array([30, 40]), np.array([2000, 1000])
    alone = packing.Plan(100)
    for k in (1, 0):
        alone.fit(int(lengths[k]), 0, int(counts[k]))
    n = filled(packing.pack(lengths, counts, 100), lengths, counts, 100)
    assert n <= 1020 < alone.sequences


# --- phrase mining


def brute_phrases(rows, words=3, least=10, cover=50, top=2000):
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(ws[i : i + n]) for n in range(1, words + 1) for i in range(len(ws) - n + 1))
    out = []
    for lang, own in f.items():
        n, found = sum(c for p, c in own.items() if len(p) == 1), []
        long = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        covered = Counter()
        for p, c in long.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], c)
        for p, a in long.items():
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if 100 * covered[p] < cover * a or not covered[p]:
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_phrases_are_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(queries.op12_phrase_mining(spark, sf), connect(sf), queries.ORACLES["op12_phrase_mining"]) is None


TEXTS = [("en", "The big cat. A BIG cat\tsat; the big cat sat"), (None, "the big cat sat, the big"), ("und", "the big cat"), ("en", None), ("en", ""), ("fr", "x"), ("en", "cat cat cat cat\x1ccat ÉtÉ été")] * 4


@pytest.mark.parametrize("kw", [{}, {"group": 3}, {"group": 1, "slots": 4}, {"words": 2}, {"words": 4, "least": 4}, {"words": 4, "least": 4, "group": 2}, {"top": 2}, {"cover": 101}])
def test_phrases_by_brute_force(spark, kw, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 9)
    df = spark.createDataFrame([(*x, 1, "clash") for x in TEXTS], "lang string, text string, rank int, phrase string").repartition(3)
    brute = {k: v for k, v in kw.items() if k not in ("group", "slots")}
    assert mined(df, **kw) == brute_phrases(TEXTS, **brute)
    assert mined(df, **kw)


def test_phrases_of_odd_and_no_texts(spark):
    rows = [(None, t) for _, t in ODD]
    assert mined(odd_frame(spark), least=2) == brute_phrases(rows, least=2)
    assert phrases.collocations(empty_frame(spark)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(odd_frame(spark), words=1)


def test_projection_by_many_words_does_not_overflow():
    names, at = pa.array([f"w{k}" for k in range(50)]), np.tile(np.arange(50), 4)
    got = phrases.project(names, at, np.ones(50, dtype=np.uint8), np.arange(50, dtype=np.uint64), 12).to_pylist()
    assert sum(np.frombuffer(r["times"], "<u4").sum() for r in got) == 199
    follow = next(r["follow"] for r in got if r["prefix"] == "w1").split(" ")
    assert follow == [f"w{k}" for k in range(2, 13)]


# --- importance resampling


def brute_draw(rows, target, percent=5, least_words=20):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode("utf-8", "surrogatepass")) % 10_000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]

    all_of = [(doc, *features(text)) for doc, text in rows]
    s, t = Counter(b for *_, bs in all_of for b in bs), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for doc, n, bs in all_of:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([doc, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("coarse", [importance.COARSE, 3])
def test_draw_by_brute_force(spark, sf_dir, coarse, monkeypatch):
    monkeypatch.setattr(importance.draw, "__defaults__", (*importance.draw.__defaults__[:-1], coarse))
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    target = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    got = queries.op13_importance_resampling(spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_draw(rows, target)


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_draw_of_odd_texts(spark, percent, monkeypatch):
    monkeypatch.setattr(importance, "WORDS_KEPT", 4)
    target = ["some words of a text", None, ""]
    got = importance.resample(odd_frame(spark), spark.createDataFrame([(t,) for t in target], "text string"), percent, least_words=1)
    assert Counter(map(tuple, got.collect())) == brute_draw(ODD, target, percent, 1)


def test_draw_from_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty_frame(spark), none).count() == 0
    assert {r["rank"] for r in importance.resample(odd_frame(spark), none, least_words=10**9).collect()} == {None}


def test_ranks_among_equal_scores(spark, tmp_path):
    rows = [(d, 30, 7, 0, 5) for d in (4, 2, 9, 2, None)] + [(1, 30, 7, 0, 6), (7, 3, 7, 0, 99)]
    spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").write.parquet(str(tmp_path / "s"))
    got = importance.draw(spark.read.parquet(str(tmp_path / "s")), percent=80, least_words=20).collect()
    assert sorted(((r["rank"], r.doc_id) for r in got), key=str) == sorted([(1, 1), (2, 2), (3, 2), (4, 4), (None, 9), (None, None), (None, 7)], key=str)
