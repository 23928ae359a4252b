import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from auditspark.llm import common, components, decontaminate, embedding_dedup, html_extract, queries, sentencepiece, sharding, simhash, tiles, token_count, toxicity, warc
from auditspark.llm.common import table
from tests.llm.odd_texts import ODD, empty_frame, odd_frame


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- token counts


def test_token_counts_are_those_of_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.BYTE_BPE)
    known = Tokenizer.from_file(path)
    for df in (table(spark, sf_dir, "documents"), odd_frame(spark)):
        texts = sorted((r.doc_id or 0, r.text or "") for r in df.collect())
        want = [(i, len(t.encode()), len(known.encode(t, add_special_tokens=False).ids)) for i, t in texts]
        got = token_count.count_tokens(df, path).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_count.count_tokens(empty_frame(spark), path).count() == 0


def test_token_cache_starts_anew(monkeypatch):
    path = public_tokenizers.path(queries.BYTE_BPE)
    want = token_count.token_counts(["some words of a text", "other words"], path)
    monkeypatch.setattr(token_count, "CACHE_ENTRIES", 2)
    assert token_count.token_counts(["some words of a text", "other words"], path) == want


# --- html

ARTICLE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, yes, we do.</p></div>
<div id="wrap"><div class="content"><h1>Title &amp; more</h1><p>First   paragraph,\n with <b>bold</b>, and text.<p>Second one, unclosed<br>and broken</p>
<div class="ad">Buy, buy, buy</div><ul><li>one</li><li>two</li></ul><form><label>Mail</label><button>Go</button></form>
<div id="comments"><p>Nice post, thanks, a reader writes at length here, indeed.</p></div></div><aside><p>Aside, of no use</p></aside></div><footer>&copy; x</footer></body></html>"""


def test_article_without_what_is_around_it():
    assert html_extract.main_text(ARTICLE) == "Title & more\nFirst paragraph, with bold, and text.\nSecond one, unclosed and broken\none\ntwo"


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>", ""), ("<p>a</p><p>b", "a\nb"), ("<!-- never ends", ""), ("<p>x</p><a hre", "x"), ("<div>" * 5000 + "deep", "deep"), ("a < b", "a < b"), ("<script>x", "")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_pages_of_the_table_hold_their_article(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    got = queries.op2_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p.replace("<b>", "").replace("</b>", ""))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


LONG = "A sentence, of some length, which tells something, and goes on for a while."


@pytest.mark.parametrize("depth", [10, 300, 3000])
def test_deep_pages_lose_nothing_and_keep_nothing_left_out(depth):
    page = "<body>" + "<div>" * depth + f"<nav>menu</nav><div hidden>secret</div><p>{LONG}</p>" + "</div>" * depth + "<p>after it all, too</p>"
    assert html_extract.main_text(page) == f"{LONG}\nafter it all, too"


def test_class_words_alone_take_no_article():
    for name in ("content has-sidebar", "with-sidebar", "sidebar", "search results", "related"):
        assert html_extract.main_text(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"
    assert html_extract.main_text(f"<body><div class='sidebar'><p>{LONG}</p></div><div class='text'><p>{LONG * 4}</p></div>") == LONG * 4


def test_link_lists_short_paragraphs_and_bare_text_of_an_article_stay():
    links = "<ul><li><a href='x'>Source one</a></li><li><a href='y'>Source two</a></li></ul>"
    menu = "<ul><li><a href='m'>menu</a></li></ul>"
    assert html_extract.main_text(f"<body>{menu}<div class='content'><p>{LONG * 3}</p>{links}</div>") == f"{LONG * 3}\nSource one\nSource two"
    page = f"<body><div><div class='article'>{f'<p>{LONG}</p>' * 9}</div>bare <b>text</b><p>Short end.</p><p><a href='x'>More</a></p></div>"
    assert html_extract.main_text(page) == "\n".join([LONG] * 9 + ["bare text", "Short end."])


@pytest.mark.parametrize("name", ["respond", "comments", "disqus", "comment-list"])
def test_names_of_comments_around_the_whole_article_take_nothing(name):
    assert html_extract.main_text(f"<body><nav><a href='/'>Home</a></nav><div class='{name}'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>") == f"Title\n{LONG}\n{LONG}"
    page = f"<body><div class='content'><p>{LONG}</p></div><div class='{name}'>" + f"<p>{LONG} A reader.</p>" * 9 + "</div>"
    assert html_extract.main_text(page) == LONG


def test_negative_blocks_of_links_and_named_paragraphs_go():
    inner = f"<p>{LONG}</p><div class='share-bar'><a href='t'>Tweet</a> <a href='p'>Post</a></div><p class='advert'>Buy this now, really.</p><p>{LONG}</p><p class='promo'>More offers.</p>"
    for page in (f"<body><article>{inner}</article>", f"<body><div class='content'>{inner}</div>"):
        assert html_extract.main_text(page) == f"{LONG}\n{LONG}"
    assert html_extract.main_text(f"<body><article><p>{LONG}</p><div class='sources'><a href='t'>Source</a></div></article>") == f"{LONG}\nSource"


def test_menus_without_names_before_the_first_paragraph_go():
    menu = "<div><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></div>"
    assert html_extract.main_text(f"<body>{menu}<p>{LONG}</p>") == LONG
    assert html_extract.main_text(f"<body>{menu}<p>{LONG}</p><div><ul><li><a href='s'>Source</a></li></ul></div><p>{LONG}</p>") == f"{LONG}\nSource\n{LONG}"


def test_null_pages(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 3)], "page_id long, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html_extract.extract_text(df).collect()] == [("", 0), ("", 0)]
    assert html_extract.extract_text(df.where("false")).count() == 0


# --- simhash


def brute_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 400")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    want = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_simhash_of_odd_texts(spark):
    got = rows_of(simhash.simhash_components(odd_frame(spark)))
    assert len(got) == len(ODD)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3)} == {"0" * 16}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (11, 12)} == {11}
    assert simhash.simhash_components(empty_frame(spark)).count() == 0


@pytest.mark.parametrize("tile_rows", [3, 7, 1000])
def test_fingerprint_links_lose_nothing_in_small_tiles(spark, tile_rows):
    rng = random.Random(tile_rows)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(25)})
    want = brute_components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 2])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.linked_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), tile_rows=tile_rows)
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    groups, got = defaultdict(set), defaultdict(set)
    for x in fps:
        groups[want[x]].add(signed(x))
        got[roots.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def near_texts(rng, n=60):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        text = rng.choices(words, k=rng.randint(20, 300))
        out.append(text)
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append(other)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("tile_rows", [5, 10_000])
def test_near_copies_of_word_shingles(spark, tile_rows):
    texts = near_texts(random.Random(5))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = brute_components(range(len(texts)), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.least: r.root for r in simhash.near_duplicate_classes(df, tile_rows=tile_rows).collect()}
    first = {}
    assert {i: want[first.setdefault(texts[i], i)] for i in got} == got
    kept = simhash.keep_one_of_each(df.withColumn("extra", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_near_copies_of_a_lower_similarity(spark):
    texts = near_texts(random.Random(8), 30)
    sets = [set(simhash.shingle_hashes(t, 3).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    want = brute_components(range(len(texts)), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.keep_one_of_each(df, words=3, similarity=0.6)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_no_link_of_the_wanted_similarity_is_lost(spark):
    rng = random.Random(12)
    texts = []
    for k in range(700):
        words = [f"v{rng.randrange(10**6)}" for _ in range((8, 8, 8, 19)[k % 4])]
        texts += [" ".join(words), " ".join([*words, *(f"u{rng.randrange(10**6)}" for _ in range((1, 1, 1, 3)[k % 4]))])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = {a: a - 1 for a in range(1, len(texts), 2) if len(sets[a] & sets[a - 1]) >= 0.8 * len(sets[a] | sets[a - 1])}
    assert len(want) == 700
    got = {r.least: r.root for r in simhash.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: want.get(i, i) for i in range(len(texts))}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_similar_sets_share_a_first_shingle_and_pass_the_bounds(similarity):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        out = rng.permutation(n)[: int((1 - similarity) * n + 1e-9)]
        cut = int(rng.integers(0, len(out) + 1))
        one, two = np.delete(union, out[:cut]), np.delete(union, out[cut:])
        assert len(np.intersect1d(one, two)) >= similarity * n - 1e-9
        common = union[rng.random(n) < 0.3]
        level = rng.integers(1, 4, len(common))
        first = [simhash.first_shingles(x, similarity, common, level) for x in (one, two)]
        assert np.intersect1d(*first).size
        signs = np.stack([simhash.parities(one), simhash.parities(two)])
        assert len(list(simhash.possible_pairs(signs, np.array([len(one), len(two)]), similarity))) == 1


def test_wide_parities_lose_no_pair():
    """Sets differ in at least as many shingles as their wide parities in cells, also between classes of size; unlike large sets are told apart."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    sets = []
    for n in (300, 500, 515, 900, 1020, 1030, 1800, 2040, 2060):
        common = draw(n)
        sets += [np.unique(np.concatenate([common, draw(k)])) for k in (0, 7, n // 10, n // 5)]
    wide = simhash.Wide(pa.array([simhash.wide_parities(x) for x in sets], pa.list_(pa.int64())))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))]
    x, y = (np.array(p) for p in zip(*pairs, strict=True))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    assert wide.close(x, y, apart).all()
    large = np.minimum(wide.words[x], wide.words[y]) > 0
    sizes = np.array([len(s) for s in sets])
    unlike = large & (apart > 0.9 * (sizes[x] + sizes[y]))
    assert unlike.any() and not wide.close(x, y, (sizes[x] + sizes[y]) / 9)[unlike].any()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_keep_one_of_repeated_rows_on_either_side_of_the_broadcast(spark, monkeypatch, few):
    """Rows of one id and text, ids and texts of several rows, null ids and columns with clashing names; joins by shuffle and by broadcast give the same."""
    monkeypatch.setattr(common, "FEW_ROWS", few)
    one, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))
    rows = [(1, one), (1, one), (1, one), (2, one), (3, near), (3, near), (4, "of its own"), (4, "of its own"), (5, "only once"), (None, "without id"), (None, "without id"), (None, one), (6, None), (7, "")]
    df = spark.createDataFrame([(i, t, "k", -1, "a") for i, t in rows], "doc_id long, text string, key string, least long, node string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [(None, "without id"), (1, one), (4, "of its own"), (5, "only once"), (6, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda x: x[0] or 0) == want
    assert {(r.key, r.least, r.node) for r in kept.collect()} == {("k", -1, "a")}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_keep_one_of_odd_texts(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    kept = simhash.keep_one_of_each(odd_frame(spark))
    assert kept.columns == odd_frame(spark).columns
    texts = Counter(r.text or "" for r in kept.collect())
    assert set(texts.values()) == {1}
    assert set(texts) == {t or "" for _, t in ODD} - {"ONE Two three"} | {"ONE Two three"}
    assert simhash.keep_one_of_each(empty_frame(spark)).count() == 0


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1050)] + [(3, 3), (1000, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(1000, 1050)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_few_pieces_and_join_once(spark, monkeypatch):
    pieces = []
    monkeypatch.setattr(components, "checkpoint", lambda df: pieces.append((out := common.checkpoint(df)).rdd.getNumPartitions()) or out)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.root for r in components.connected_components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20}
    assert len(pieces) > 4 and set(pieces[1:]) == {1}


# --- decontamination


def brute_contamination(text, items):
    words = decontaminate.words_of(text)
    hit, owners = set(), []
    for i, item in items:
        own = decontaminate.words_of(item)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        at = [k for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in windows]
        hit |= {k + j for k in at for j in range(n)}
        owners += [str(i)] if at and str(i) not in owners else []
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_contamination_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, "The quick brown fox jumps over the lazy dog and then sleeps all day long"), (2, "short item"), (3, None), (4, "short item"), (5, "!!"), (10, "dog and then sleeps all day long until the night comes again"), (7, "alpha beta"), (7, "beta gamma"), (2, "alpha beta")]
    docs = [*ODD, (20, "A SHORT, item; the-quick brown fox jumps over the lazy dog and then sleeps all day long until the night comes again"), (21, "shorts item short itemx"), (22, "short item short item"), (23, "alpha beta gamma"), (23, "alpha beta gamma"), (24, "beta gamma delta")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, bench).collect())
    assert got == Counter((i, *brute_contamination(t, items)) for i, t in docs)
    clean = decontaminate.drop_contaminated(df, bench)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in docs if not brute_contamination(t, items)[4])
    assert decontaminate.contamination(empty_frame(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.where("false")).collect())


def test_hit_spans_point_into_the_original():
    windows = decontaminate.Windows([(1, "naïve idea")])
    text = "Ünï — A Naïve,\n IDEA! x"
    assert [text[a:b] for a, b in decontaminate.hit_spans(text, windows)] == ["Naïve,\n IDEA"]


# --- toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    bad = [r.score for r in got if labels[r.doc_id]]
    good = [r.score for r in got if not labels[r.doc_id]]
    better = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert better > 0.95
    assert sum(s >= 0.5 for s in good) / len(good) < 0.01


def trained():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        t = rng.choices(words, k=rng.randint(5, 60))
        if i % 5 == 0:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["nastyish", "nastyly", "vile"]))
        texts.append(" ".join(t))
        labels.append(i % 5 == 0)
    return toxicity.train(texts, np.array(labels))


def test_chain_marginals_are_those_of_each_step():
    model = trained()
    text = "Word1 word2, nastyish word3 vile word4 word5 word6 nastyly"
    words = toxicity.WORD.findall(text)
    emit = np.array([[1, math.exp(model.bias if (e := model.emission(w)) is None else e)] for w in words])
    best = np.zeros((len(words), 2))
    for path in np.ndindex(*(2,) * len(words)):
        p = math.prod(emit[k, y] for k, y in enumerate(path)) * math.exp(sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for k, y in enumerate(path):
            best[k, y] += p
    n, at, marginals = model.marginals(text)
    assert n == len(words) and len(at) >= 3
    assert np.allclose(marginals, (best[:, 1] / best.sum(axis=1))[at], atol=1e-9)
    assert [text[a:b] for a, b in model.spans(text)] == ["nastyish", "vile", "nastyly"]


def test_training_on_the_driver_holds_little_beside_the_texts():
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(150)) + (" vile nasty" if k % 2 else "") for k in range(600)]
    toxic = np.arange(600) % 2 == 1
    column = pa.chunked_array([pa.array(texts)])
    del texts
    tracemalloc.start()
    try:
        model = toxicity.train(toxicity.Texts(column, np.arange(600)), toxic, rounds=5)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert not model.cache and "vile" in model.weights
    assert peak < 16


def test_training_without_words():
    assert toxicity.train(["", "..."], np.array([True, False])).score("a") < 0.5


def test_toxicity_of_odd_texts(spark):
    model = spark.sparkContext.broadcast(trained())
    got = rows_of(toxicity.score_toxicity(odd_frame(spark), model))
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.drop_toxic(odd_frame(spark), model).count() == len(ODD)
    bad = spark.createDataFrame([(1, "a VILE nastyish thing"), (2, "word1 word2")], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.drop_toxic(bad, model).collect()] == [2]
    assert toxicity.score_toxicity(empty_frame(spark), model).count() == 0
    untrained = spark.sparkContext.broadcast(toxicity.train([], np.array([])))
    assert {r.predicted for r in toxicity.score_toxicity(bad, untrained).collect()} == {0}


def test_labelled_words_late_in_a_text_are_learned():
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    fill = lambda n: " ".join(rng.choices(words, k=n))
    texts = [f"{' '.join(['vile'] * 45)} {fill(20_000)} gross {fill(40)}" for _ in range(20)] + [fill(60) for _ in range(60)]
    model = toxicity.train(texts, np.array([True] * 20 + [False] * 60))
    assert max((w for f, w in model.weights.items() if "gro" in f), default=0) > 0.5


# --- pieces


def test_pieces_are_those_of_the_library(spark, sf_dir):
    import sentencepiece as library

    path = public_tokenizers.path(queries.PIECES)
    known = library.SentencePieceProcessor(model_file=path)
    for df in (table(spark, sf_dir, "documents"), odd_frame(spark)):
        got = sentencepiece.encode_pieces(df, path).collect()
        want = Counter((r.doc_id, tuple(known.encode(r.text or ""))) for r in df.collect())
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    back = {r.doc_id: r.text for r in sentencepiece.decode_pieces(sentencepiece.encode_pieces(table(spark, sf_dir, "documents"), path), path).collect()}
    assert back == {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert sentencepiece.encode_pieces(empty_frame(spark), path).count() == 0


def test_best_path_by_scores():
    own = sentencepiece.pieces.__wrapped__(public_tokenizers.path(queries.PIECES))
    own.by_merging = False
    own.score = [-1.0 - 0.3 * (len(t) == 1) for t in own.texts]
    word = "▁hello▁thereabouts"
    ids = own.search(word)
    n = len(word)
    best = [0.0] + [-1e9] * n
    for i in range(1, n + 1):
        for j in range(i):
            if (k := own.ids.get(word[j:i])) is not None:
                best[i] = max(best[i], best[j] + own.score[k])
    assert sum(own.score[i] for i in ids) == pytest.approx(best[n])


# --- warc


def archive_bytes(spark, tmp_path, compressed=False):
    import gzip

    records = []
    for k in range(6):
        block = f"HTTP/1.1 200 OK\r\n\r\npage {k} WARC/1.1 inside\r\n\r\n".encode() * (k + 1)
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        records.append(head + block + b"\r\n\r\n")
    return [gzip.compress(r, mtime=0) if compressed else r for r in records]


@pytest.mark.parametrize("compressed", [False, True])
def test_salvage_of_damaged_archives(spark, tmp_path, compressed):
    parts = archive_bytes(spark, tmp_path, compressed)
    whole = b"".join(parts)
    ids = lambda s: [r.headers["warc-record-id"] for r in s.records]
    assert ids(warc.salvage(whole)) == [f"<urn:page:{k}>" for k in range(6)] and not warc.salvage(whole).gaps
    hurt = bytearray(whole)
    at = len(parts[0]) + len(parts[1]) // 2
    hurt[at : at + 4] = b"\x00\x01\x02\x03"
    found = warc.salvage(bytes(hurt))
    assert set(ids(found)) == {f"<urn:page:{k}>" for k in (0, 2, 3, 4, 5)}
    assert sum(n for _, n, _ in found.gaps) >= len(parts[1]) - 4
    cut = warc.salvage(whole[: -len(parts[5]) // 2])
    assert ids(cut)[:5] == [f"<urn:page:{k}>" for k in range(5)] and cut.gaps
    junk = warc.salvage(b"junk" * 5 + whole)
    assert len(junk.records) == 6 and junk.gaps[0][:2] == (0, 20)
    assert warc.salvage(b"").records == [] and warc.salvage(b"nothing here").gaps


def test_archive_and_back(spark, tmp_path):
    long = "<p>" + "ü" * 600
    pages = [(1, "http://a\r\nX: y", long, 1), (2, None, long, 1), (3, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (None, "u", "none", 1), (7, "u", "b" * 1000, 1), (7, "u", "b" * 1000, 1), (8, "u", "text\r\n\r\nWARC/1.1\r\nfake\r\n\r\n", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    read = warc.read_archive(spark, path)
    assert read.where("type = 'gap'").count() == 0
    got = Counter(tuple(r) for r in warc.page_records(read).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), sha(t), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, t, _ in pages)
    assert got == want
    empty = str(tmp_path / "empty")
    warc.write_archive(df.where("false"), empty)
    assert warc.page_records(warc.read_archive(spark, empty)).count() == 0


def test_salvage_of_a_damaged_file_of_the_writer(spark, tmp_path):
    import gzip

    pages = [(k, f"http://a/{k}", hashlib.sha512(str(k).encode()).hexdigest() * 20) for k in range(40)]
    path = tmp_path / "archive"
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(path))
    files = sorted(x for x in path.iterdir() if x.name.startswith("part-"))
    found = [warc.salvage(x.read_bytes()) for x in files]
    assert sum(len(x.records) for x in found) == 40 and not any(x.gaps for x in found)
    whole = max((x.read_bytes() for x in files), key=len)
    n = len(warc.salvage(whole).records)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == n > 4
    for at in range(len(whole) // 7, len(whole), len(whole) // 5):
        hurt = bytearray(whole)
        hurt[at] ^= 0x55
        assert len(warc.salvage(bytes(hurt)).records) >= n - 1


def test_content_before_a_fault_is_kept(spark, tmp_path):
    import gzip

    one = bytearray(gzip.compress(b"".join(archive_bytes(spark, tmp_path)), mtime=0))
    one[-8] ^= 1
    found = warc.salvage(bytes(one))
    assert len(found.records) == 6 and found.gaps
    big = warc.member_line(b"x" * warc.LAST_BYTES) + warc.LAST.encode() + warc.member_line(b"y") + warc.LAST.encode()
    assert gzip.decompress(big) == b"x" * warc.LAST_BYTES + b"y" and [f for _, _, f in warc.members(big)] == ["", "", ""]


# --- embeddings


def brute_links(vectors):
    ok = {i: np.array(v, dtype=np.float64) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    return [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]


def check_embeddings(spark, vectors, kind="float"):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    links = brute_links(vectors)
    n = Counter(x for p in links for x in p)
    root = brute_components([i for i, _ in vectors], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect()}
    return got, {i: (n[i], root[i], root[i] == i) for i, _ in vectors}


@pytest.mark.parametrize("tile_rows", [8, 2048])
def test_embedding_links(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    vectors = [v for v in base]
    vectors += [base[0] + 0.05 * rng.normal(size=64) for _ in range(40)]
    vectors += [base[1]] * 5 + [base[k] + 0.1 * rng.normal(size=64) for k in range(2, 30)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [float("inf")] + [1.0] * 63), (1005, [None] + [1.0] * 63), (1006, [1.0, 2.0]), (1007, [1.0, 2.0, 0.0])]
    for kind in ("float", "double"):
        got, want = check_embeddings(spark, rows, kind)
        assert got == want


def test_embedding_recall(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.955 * a + math.sqrt(1 - 0.955**2) * side
    got, want = check_embeddings(spark, [(i, [float(x) for x in v]) for i, v in enumerate([*a, *b])])
    assert sum(x[0] for x in got.values()) >= 0.95 * sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in got)
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    got, want = check_embeddings(spark, rows)
    assert got == want


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x, near = rng.normal(size=(500, 8)) * 2, embedding_dedup.minimal_vectors()
    point = embedding_dedup.decode_e8(x) / 2
    other = ((x[:, None] - point[:, None] - near[None]) ** 2).sum(axis=2).min(axis=1)
    assert len(near) == 240 and (((x - point) ** 2).sum(axis=1) <= other + 1e-9).all()


# --- shards


def test_shards_are_near_equal(spark):
    got = queries.op9_sharding(spark, "/root/testdata/sf0.1").collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 8
    assert sorted(load) == list(range(8))
    assert max(load.values()) <= 1.002 * mean and min(load.values()) > 0.985 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_further_shard_moves_few(spark):
    sizes = np.random.default_rng(0).integers(1, 1000, size=65_536)
    eight, nine = sharding.place_slices(sizes, 8), sharding.place_slices(sizes, 9)
    moved = sizes[eight != nine].sum() / sizes.sum()
    assert moved < 0.35
    assert max(np.bincount(nine, weights=sizes)) <= 1.003 * sizes.sum() / 9


def test_shards_of_odd_texts(spark):
    got = rows_of(sharding.assign_shards(odd_frame(spark), 3))
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.assign_shards(empty_frame(spark)).count() == 0


# --- SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    from tests.oracle import connect, difference

    sf = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


# --- tiles and the pipeline


def test_tiles_hold_each_pair_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "bucket long, id long")
    dealt = tiles.deal_tiles(rows, "id", 10).collect()
    groups = defaultdict(list)
    for r in dealt:
        groups[(r.tile_a, r.tile_b)].append(r)
    seen = Counter()
    for (a, b), g in groups.items():
        seen.update(tuple(sorted((x.id, y.id))) for x in g for y in g if x.id != y.id and x.chunk == a and y.chunk == b and (a != b or x.id < y.id))
    assert len(seen) == 50 * 49 // 2 and set(seen.values()) == {1}
    assert {r.bucket for r in dealt} == {1}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= docs.count() and out.where("not round_trip").count() == 0


def test_files_of_large_pages_have_few_records_and_gaps_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 3000)
    monkeypatch.setattr(warc, "FILE_ROWS", 10)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    pages = [(k, f"https://a.com/{k}", text(100 if k % 3 else 9000 + k)) for k in range(60)]
    df, path = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), tmp_path / "warc"
    warc.write_archive(df, str(path))
    files = sorted(path.glob("*.txt"))
    sizes = [sum(len(r.payload) for r in warc.salvage(f.read_bytes()).records) for f in files]
    assert len(files) >= 4 + 7 and max(sizes) <= 30_000
    read = warc.read_archive(spark, str(path))
    assert {r.page_id: r.payload_bytes for r in warc.page_records(read, strict=True).collect()} == {k: len(t) for k, _, t in pages}
    assert warc.gaps(read).count() == 0
    data = bytearray(files[0].read_bytes())
    data[200] ^= 255
    files[0].write_bytes(bytes(data))
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    told = warc.gaps(read).collect()
    assert told and all(g.gap_length > 0 and g.file.endswith(files[0].name) for g in told)
    assert 0 < warc.page_records(read).count() < 60
    with pytest.raises(Exception, match="quarantined bytes in"):
        warc.page_records(read, strict=True).collect()
