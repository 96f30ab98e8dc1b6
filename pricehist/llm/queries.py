"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricehist.llm import bpe, dedup_exact, dedup_near, divergence, filter_audit, langid, packing, quality, suffix_dedup, token_counts, topk, toxicity, url_filters
from pricehist.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(token_counts.with_edits(table(spark, sf_dir, "documents")), WORD_BPE)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filters.dated_captures(table(spark, sf_dir, "pages"))
    return url_filters.evaluate(captures, url_filters.dated_list(captures))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_near.near_duplicates(table(spark, sf_dir, "documents"), width=3, least=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact.dedup(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_language_id": op5_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_top_k": op10_top_k,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op4_url_filters": r"""
        WITH captures AS (
            SELECT page_id, CAST(page_id * 13 % 366 AS INTEGER) AS day, regexp_extract(lower(coalesce(url, '')),
                '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*[^/?#:@.])\.*(?::[^/?#@]*)?(?:[/?#]|\z)', 1) AS host FROM pages
        ), levels AS (
            SELECT page_id, day, host, array_to_string(string_split(host, '.')[k:], '.') AS domain, len(string_split(host, '.')) AS n, k
            FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(k)
        ), firsts AS (
            SELECT domain, min(page_id) AS m FROM levels WHERE host <> '' AND k <= greatest(n - 1, 1) GROUP BY domain HAVING min(page_id) % 3 <> 0
        ), lines AS (
            SELECT domain, m * 37 % 200 AS day, true AS added FROM firsts
            UNION ALL SELECT domain, m * 37 % 200 + m * 11 % 90 + 5, false FROM firsts
            UNION ALL SELECT domain, m * 37 % 200 + 120, true FROM firsts WHERE m % 2 = 0
        ), states AS (
            -- the last line at or before the fetch; of two on one day the removal holds
            SELECT page_id, l.host, l.day, l.domain, max(x.day) AS since, bool_and(x.added) FILTER (x.day = (SELECT max(y.day) FROM lines y
                WHERE y.domain = l.domain AND y.day <= l.day)) AS listed
            FROM levels l LEFT JOIN lines x ON x.domain = l.domain AND x.day <= l.day GROUP BY page_id, l.host, l.day, l.domain
        )
        SELECT page_id, host, day, coalesce(bool_or(listed), false) AS listed,
            arg_max(domain, length(domain)) FILTER (listed) AS domain, CAST(arg_max(since, length(domain)) FILTER (listed) AS INTEGER) AS since
        FROM states GROUP BY page_id, host, day""",
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.vec, c.vec) DESC, c.vec_id)
        QUALIFY row_number() OVER best <= 20""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op12_filter_audit": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), marks AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
        ), fails AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
                coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f
            FROM docs LEFT JOIN marks USING (doc_id)
        ), failed AS (
            SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[ascii(x) - 64]) AS failed, count(*) AS n FROM fails GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders
        ), counted AS (
            SELECT part, o, step, CAST(coalesce(sum(n) FILTER (NOT list_has_any(failed, o[:step])), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (list_contains(failed, o[step]) AND list_has_any(failed, o[:step - 1])), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (failed = [o[step]]), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(n) FILTER (good AND list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(n) FILTER (toxic AND list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])), 0) AS BIGINT) AS toxic_lost
            FROM failed, steps GROUP BY part, o, step
        )
        SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM counted""",
    "op13_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ), terms AS (
            SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c, count(DISTINCT d) AS df FROM (SELECT lang, source, d, unnest(w) AS term FROM docs) GROUP BY lang, source, term
        ), kept AS (SELECT lang, term, sum(c) AS c FROM terms GROUP BY lang, term HAVING sum(df) >= 30
        ), langs AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang
        ), cells AS (SELECT t.lang, t.source, t.term, t.c, k.c AS lang_c FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term
        ), groups AS (
            SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
        ), levels AS (
            SELECT g.lang, g.source, k.term, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (g.n + 5 * l.v) AS p, 1 + (1000000000 * (k.c + 5)) // (l.n + 5 * l.v) AS q, coalesce(c.c, 0) AS c
            FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM levels a JOIN levels b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM levels WHERE c > 0 AND p > q
        )
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
        QUALIFY part = 'pair' OR rank <= 50""",
}
