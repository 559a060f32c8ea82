"""The queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, lm_score, media, merkle, near_dedup, packing, piece_bpe, suffix_dedup, token_counts, toxicity, url_filter
from .common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: The rules that op5 judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), path, packed=True, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so one is drawn from each vector; every fifth is an edited copy of another."""
    return media.image_copies(media.media_from_vectors(table(spark, sf_dir, "embeddings")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    coded = piece_bpe.piece_encode(table(spark, sf_dir, "documents"), path, packed=True, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return merkle.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered=tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_media_copies": op6_media_copies,
    "op7_lm_score": op7_lm_score,
    "op8_near_dedup": op8_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_pack": op10_best_fit_pack,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Normalised text and its digest, for the SQL below.
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_url_filter": r"""
        WITH p AS (
          SELECT page_id,
                 translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END,
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
          FROM pages),
        r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT page_id, host, path,
                     (SELECT arg_max(r.h || r.p, length(r.h || r.p)) FROM r
                      WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS rule
              FROM p)
        SELECT page_id, host, path, rule,
               coalesce((SELECT v FROM r WHERE r.h || r.p = rule), 'allow') AS verdict
        FROM m""",
    "op12_filter_audit": r"""
        WITH w AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                 list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        m AS (
          SELECT doc_id, part,
                 (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT
                 + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
          FROM w),
        l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
          SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (
          SELECT part, filter_order, step, bit,
                 coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
          FROM s, c GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
        FROM r""",
    "op13_merkle_manifest": r"""
        WITH RECURSIVE digits AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
        crc(doc_id, s, k, c) AS (
          -- CRC-32 by bits: a byte enters every eighth step
          SELECT doc_id, s, 0, 4294967295::BIGINT FROM digits
          UNION ALL
          SELECT doc_id, s, k + 1,
                 list_reduce([xor(c, ascii(s[k + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
          FROM crc WHERE k < length(s)),
        sums AS (SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS hit FROM crc WHERE k = length(s)),
        d AS (
          SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
          FROM documents),
        h AS (
          SELECT d.doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS bad
          FROM d LEFT JOIN sums USING (doc_id)),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
        low(g, lvl, pos, h, n) AS (
          SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM leaves
          UNION ALL
          SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY g, lvl, pos // 16),
        subroots AS (SELECT g, h AS subroot FROM low WHERE n = 1),
        top(lvl, pos, h, n) AS (
          SELECT 0, g, subroot, count(*) OVER () FROM subroots
          UNION ALL
          SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
        sides AS (
          SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                 coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
          FROM (SELECT g, lvl, pos, h FROM low WHERE n > 1 UNION ALL SELECT -1, lvl, pos, h FROM top WHERE n > 1)
          WINDOW w AS (PARTITION BY g, lvl, pos // 16 ORDER BY pos)),
        steps AS (
          SELECT l.g, l.pos, row_number() OVER (PARTITION BY l.g, l.pos ORDER BY s.g < 0, s.lvl) AS step, a, b
          FROM leaves l JOIN sides s ON s.g = l.g AND s.pos = l.pos // (16::BIGINT ** s.lvl)::BIGINT OR s.g = -1 AND s.pos = l.g // (16::BIGINT ** s.lvl)::BIGINT),
        fold(g, pos, step, node) AS (
          SELECT g, pos, 0, coalesce(bad, leaf) FROM leaves
          UNION ALL
          SELECT f.g, f.pos, f.step + 1, sha256(a || node || b) FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.step = f.step + 1),
        ends AS (SELECT g, pos, arg_max(node, step) AS folded_root FROM fold GROUP BY g, pos),
        proofs AS (SELECT g, pos, sha256(string_agg(a || b, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY g, pos)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN subroots USING (g) JOIN ends USING (g, pos) LEFT JOIN proofs USING (g, pos), (SELECT h AS root FROM top WHERE n = 1)""",
}
