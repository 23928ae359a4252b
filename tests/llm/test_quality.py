"""The quality classifier against plain Python that follows its definition."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditspark.llm import quality, queries
from auditspark.llm.common import table
from tests.llm.odd_texts import ODD, empty_frame, odd_frame

START = chr(quality.START)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def brute_kneser_ney(texts, order=quality.ORDER):
    """Probability of a gram's last character after those before, by definition."""
    grams = Counter()
    for t in texts:
        s = START * (order - 1) + t
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {k: quality.discounts([Counter(c.values())[i] for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    after = defaultdict(list)
    for k, c in counts.items():
        for g, n in c.items():
            after[k, g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        follow = after.get((k, gram[:-1]))
        if not follow:
            return p(gram[1:])
        cut = lambda n: cuts[k][min(n, 3) - 1]
        n = counts[k].get(gram, 0)
        return ((n - cut(n)) / sum(follow) if n else 0.0) + sum(map(cut, follow)) / sum(follow) * p(gram[1:])

    return p


def brute_quality(rows, good):
    """(id, text, lang, fold) to perplexity, limits and decision."""
    p = {side: brute_kneser_ney([t or "" for i, t, _, f in rows if i in good and f != side]) for side in (0, 1)}
    memo = {}

    def loss(text, side):
        s = START * (quality.ORDER - 1) + text
        each = []
        for i in range(len(text)):
            key = (side, s[i : i + quality.ORDER])
            memo[key] = memo.get(key) or -math.log(p[side](key[1]))
            each.append(memo[key])
        return sum(each) / len(each)

    shrunk = lambda n: math.sqrt(n / (n + quality.SHORT))
    at = lambda values, q: sorted(values)[max(math.ceil(q * len(values)), 1) - 1]
    losses = {(i, k): loss(t, f) for k, (i, t, _, f) in enumerate(rows) if t}
    limits = {}
    for lang in {r[2] or "" for r in rows}:
        own = [(losses[i, k], len(t)) for k, (i, t, of, _) in enumerate(rows) if t and i in good and (of or "") == lang]
        if own:
            mid = at([x for x, _ in own], 0.5)
            z = [(x - mid) * shrunk(n) for x, n in own]
            wide = 1 + quality.MARGIN * (1 + quality.FEW / math.sqrt(len(own)))
            limits[lang] = mid, min(at(z, quality.QUANTILES[0]), 0) * wide, max(at(z, quality.QUANTILES[1]), 0) * wide
    out = []
    for k, (i, t, lang, _) in enumerate(rows):
        if not t:
            out.append((i, None, None, None, True))
        elif (lang or "") not in limits:
            out.append((i, math.exp(losses[i, k]), None, None, True))
        else:
            mid, low, high = limits[lang or ""]
            low, high = mid + low / shrunk(len(t)), mid + high / shrunk(len(t))
            out.append((i, math.exp(losses[i, k]), math.exp(low), math.exp(high), low <= losses[i, k] <= high))
    return out


def four_scripts(rng, n):
    """Words of four alphabets, one of them too large for any short list of common characters."""
    alphabets = {"latin": "abcdefgh", "greek": "αβγδεζηθ", "cyrillic": "абвгдежз", "han": "".join(map(chr, range(0x4E00, 0x4E00 + 300)))}
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 5))) for _ in range(40)] for k, a in alphabets.items()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 40))), lang) for i in range(n) for lang in [rng.choice(list(words))]], alphabets


@pytest.mark.parametrize("head", [1_000_000, 300, 0])
def test_scores_limits_and_decisions_are_brute_force(spark, head):
    """Whatever part of the probabilities is broadcast."""
    rng = random.Random(4)
    rows, alphabets = four_scripts(rng, 60)
    rows += [(100 + k, "".join(rng.choice(alphabets["han"]) for _ in range(60)), "han") for k in range(3)] + [(200, "no limits here", "other"), (201, None, "latin"), (202, "", None), (203, "aa bb", None)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i, _, lang in rows if i < 60 and i % 3 and lang != "other"}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(100, 0)], "doc_id long, quality int")
    folds = [r.f for r in docs.select(quality.fold(F.col("text")).alias("f")).collect()]
    want = sorted(brute_quality([(*r, f) for r, f in zip(rows, folds, strict=True)], good), key=str)
    got = sorted((tuple(r) for r in quality.score_quality(docs, labels, head=head).collect()), key=str)
    assert [(g[0], g[4]) for g in got] == [(w[0], w[4]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert [x is None for x in g] == [x is None for x in w]
        assert [x for x in g[1:4] if x is not None] == pytest.approx([x for x in w[1:4] if x is not None], rel=1e-9)


def test_random_characters_of_any_script_are_rejected(spark):
    """Large alphabets are told apart: the same characters in no order are unlike the trusted text."""
    rng = random.Random(5)
    rows, alphabets = four_scripts(rng, 400)
    junk = [(1000 + k, "".join(rng.choice(alphabets[lang] + " ") for _ in range(150)), lang) for k in range(40) for lang in [list(alphabets)[k % 4]]]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i % 2], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.score_quality(docs, labels).collect()}
    assert sum(kept[i] for i, *_ in rows) >= 0.97 * len(rows)
    assert not any(kept[i] for i, *_ in junk)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_junk_goes_and_good_stays_at_every_size(spark, sf):
    sf = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = {r.doc_id: r.kept for r in queries.op10_quality_classifier(spark, sf).collect()}
    good = [got[i] for i, q in labels.items() if q == 1]
    bad = [got[i] for i, q in labels.items() if q == 0]
    rest = [k for i, k in got.items() if i not in labels]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.2
    assert abs(sum(rest) / len(rest) - (sum(good) + sum(bad)) / len(labels)) < 0.06  # unlabelled texts fare like labelled ones


def test_odd_texts(spark):
    docs = odd_frame(spark)
    labels = spark.createDataFrame([(4, 1), (5, 1), (12, 1), (12, 1), (None, 1), (99, 1), (6, 0), (5, 0)], "doc_id long, quality int")
    got = rows_of(quality.score_quality(docs, labels))
    assert len(got) == len(ODD)
    assert all(r["kept"] and r["perplexity"] is None for r in got if r["doc_id"] in (1, 2))
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] and r["lowest"] is None for r in rows_of(quality.score_quality(docs, none)))
    assert quality.score_quality(empty_frame(spark), labels).count() == 0
    assert quality.drop_low_quality(docs.select("doc_id", "text"), labels).columns == ["doc_id", "text"]


def test_hashes_and_pieces_of_long_texts(monkeypatch):
    """Texts longer than a piece give the same n-grams."""
    texts = ["", "abc", "a" * 100, "xyz" * 50, "ü😀" * 7]
    whole = [(int(o), int(h)) for _, owner, hashes in quality._pieces(texts) for o, h in zip(owner, hashes, strict=True) if o >= 0]
    monkeypatch.setattr(quality, "PIECE", 7)
    parts = [(int(o), int(h)) for _, owner, hashes in quality._pieces(texts) for o, h in zip(owner, hashes, strict=True) if o >= 0]
    assert parts == whole and len(whole) == sum(map(len, texts))


def test_columns_of_the_names_used_inside_stay(spark):
    names = ["low", "mid", "high", "n", "q", "z", "chars", "loss", "times", "log_p", "perplexity", "kept", "quality", "toxic", "id", "h", "text_key"]
    rows = [(k, f"some plain words of text number {k % 7} that repeat", "en", *["x"] * len(names)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    got = quality.drop_low_quality(df, labels)
    assert got.columns == df.columns and got.where("low = 'x' and mid = 'x' and high = 'x'").count() == got.count() > 0
    assert quality.score_quality(df, labels).count() == 30
