"""Queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import decontaminate, embedding_dedup, html_extract, importance, packing, phrases, quality, sentencepiece, sharding, simhash, token_count, toxicity, warc
from auditspark.llm.common import shared_path, table

BYTE_BPE, PIECES, WORD_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archive(spark, path), strict=True)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, table(spark, sf_dir, "labels"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_html_extraction, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_toxicity, op6_sentencepiece, op7_warc,
        op8_embedding_near_dedup, op9_sharding, op10_quality_classifier, op11_best_fit_packing, op12_phrase_mining, op13_importance_resampling,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        iw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM iw),
        lens AS (SELECT DISTINCT n FROM win),
        spots AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d CROSS JOIN lens WHERE len(ws) >= n),
        dg AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS g FROM spots),
        hit AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS word FROM dg JOIN (SELECT DISTINCT n AS wn, g AS wg FROM win) x ON dg.n = wn AND dg.g = wg),
        nh AS (SELECT doc_id, count(*) AS n_hit FROM hit GROUP BY doc_id),
        own AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
        ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM own GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a),
        c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.root = v.vec_id AS kept
        FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN g.original IS NULL OR g.original = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN g.original <> d.page_id THEN g.original END AS refers_to
        FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000""",
    "op12_phrase_mining": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        u AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN range(1, 4) AS s(k) WHERE len(ws) >= k),
        g AS (SELECT lang, k, phrase, count(*) AS f FROM u GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= 10),
        x AS (SELECT lang, phrase, a, ws, cut, array_to_string(ws[1:cut], ' ') AS h, array_to_string(ws[cut + 1:], ' ') AS e FROM c CROSS JOIN range(1, 3) AS s(cut) WHERE cut < k),
        y AS (SELECT x.lang, x.phrase, x.a, cut, g1.f AS l, g2.f AS r, CAST(1000000::HUGEINT * a * a // (g1.f::HUGEINT * g2.f) AS BIGINT) AS score
              FROM x JOIN g g1 ON g1.lang = x.lang AND g1.phrase = x.h JOIN g g2 ON g2.lang = x.lang AND g2.phrase = x.e),
        z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c CROSS JOIN range(1, 3) AS s(i) WHERE k = 3 GROUP BY ALL),
        q AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank
              FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * a)
        SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000""",
}
