"""Registered queries: every operator over its whole table.

The operators keep their own interfaces; a query only names the table, the
production parameters and the columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfold.llm import (
    ann, conversation_repair, impact_topk, langid, minhash, packing, pii, quality, sentencepiece_scan, suffix_dedup, token_counts,
    url_filter, whitening)
from riskfold.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k(read_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.fit_and_identify(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


#: The contract's rules; pages that none of them fits are judged by patterns.
URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"),
             url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow"), *url_filter.SPAM_PATTERNS]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(read_table(spark, sf_dir, "conversations")), times="times")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_exact_topk": op3_exact_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}

#: Queries that SQL can express over whole tables.
ORACLE: dict[str, str] = {
    "op3_exact_topk": """
        WITH parts AS (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
            WHERE embedding IS NOT NULL),
        good AS (
            SELECT vec_id FROM parts GROUP BY vec_id
            HAVING count(*) = count(x) AND bool_and(isfinite(x))),
        whole AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS y FROM parts JOIN good USING (vec_id)),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.y * c.y) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10""",
    "op4_suffix_dedup": """
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        windows AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS w
            FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM docs WHERE n >= 50)),
        least AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
        hits AS (SELECT doc_id, p FROM windows JOIN least USING (w) WHERE first_doc < doc_id),
        -- hits less than 50 bytes apart, or just touching, belong to one span
        marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS begins FROM hits),
        numbered AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
        spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, span),
        gaps AS (SELECT s.doc_id, s.span, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.span), 0) AS from_, d.h
                 FROM spans s JOIN docs d USING (doc_id)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY span) AS k,
                        sum(b - a) AS removed, count(*) AS n_spans, max(b) AS last_b FROM gaps GROUP BY doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN removed IS NULL THEN d.h ELSE k || substr(d.h, 2 * last_b + 1) END)) AS kept_sha256
        FROM docs d LEFT JOIN kept USING (doc_id)""",
    "op11_url_filter": """
        WITH cut AS (
            SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        heads AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS head FROM cut),
        parts AS (
            SELECT page_id, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(head) + 1), '^[^?#]*') AS path,
                   translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM heads),
        rules(rule, verdict, rule_host, rule_path) AS (VALUES
            ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
            ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        words(word) AS (VALUES ('casino'), ('gambling'), ('pills'), ('porn'), ('spam'), ('xxx')),
        judged AS (
            SELECT p.*, (SELECT max({'n': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}) FROM rules r
                         WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)) AS r,
                   (SELECT max({'n': length(w.word) + 2, 'rule': '^' || w.word || '^'}) FROM words w
                    WHERE regexp_matches(p.small, '(^|[^a-z0-9])' || w.word || '([^a-z0-9]|$)')) AS w FROM parts p)
        SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN w IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN r IS NULL THEN w.rule END AS pattern FROM judged""",
    # crc32 bit by bit; a forward search that keeps, for each ending of the
    # roles written so far, the cheapest and then ASCII-least edits
    "op12_conversation_repair": """
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT) AS bytes
            FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
        coded AS (
            SELECT *, xor(4294967295, list_reduce(bytes, lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)) % 20 AS kind FROM keyed),
        hit AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM hit),
        faulty AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                   substr(role, 1, 1) AS h, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (i > 1 AND before || h NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
        -- the endings: 0 nothing, 1 system, 2 user, 3 assistant
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, n, {'c': 0::BIGINT, 'a': '', 'r': ''} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s1,
                   {'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'} AS s2,
                   {'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3 FROM counts
            UNION ALL
            SELECT conv_id, i, n, t0, t1, list_min([t2, {'c': t3.c + 3, 'a': t3.a || 'I', 'r': t3.r || chr(10) || 'user:'},
                        {'c': t0.c + 3, 'a': t0.a || 'I', 'r': t0.r || chr(10) || 'user:'}, {'c': t1.c + 3, 'a': t1.a || 'I', 'r': t1.r || chr(10) || 'user:'}]) AS u2,
                   list_min([t3, {'c': t2.c + 3, 'a': t2.a || 'I', 'r': t2.r || chr(10) || 'assistant:'},
                        {'c': t0.c + 6, 'a': t0.a || 'II', 'r': t0.r || chr(10) || 'user:' || chr(10) || 'assistant:'},
                        {'c': t1.c + 6, 'a': t1.a || 'II', 'r': t1.r || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS u3
            FROM (
                SELECT w.conv_id, f.i, n, {'c': s0.c + 4, 'a': s0.a || 'D', 'r': s0.r} AS t0,
                       list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 'r': s1.r},
                                 CASE WHEN ok AND h = 's' THEN {'c': s0.c + x, 'a': s0.a || 'K', 'r': s0.r || kept} END]) AS t1,
                       list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 'r': s2.r}]
                           || CASE WHEN ok AND h = 'u' THEN [{'c': s0.c + x, 'a': s0.a || 'K', 'r': s0.r || kept},
                                  {'c': s1.c + x, 'a': s1.a || 'K', 'r': s1.r || kept}, {'c': s3.c + x, 'a': s3.a || 'K', 'r': s3.r || kept}] ELSE [] END
                           || CASE WHEN ok THEN [{'c': s0.c + x + 3, 'a': s0.a || 'R', 'r': s0.r || as_user},
                                  {'c': s1.c + x + 3, 'a': s1.a || 'R', 'r': s1.r || as_user}, {'c': s3.c + x + 3, 'a': s3.a || 'R', 'r': s3.r || as_user}] ELSE [] END) AS t2,
                       list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 'r': s3.r},
                                 CASE WHEN ok AND h = 'a' THEN {'c': s2.c + x, 'a': s2.a || 'K', 'r': s2.r || kept} END,
                                 CASE WHEN ok THEN {'c': s2.c + x + 3, 'a': s2.a || 'R', 'r': s2.r || as_assistant} END]) AS t3
                FROM walk w JOIN (
                    SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS x,
                           chr(10) || role || ':' || text AS kept, chr(10) || 'user:' || text AS as_user,
                           chr(10) || 'assistant:' || text AS as_assistant FROM faulty) f
                ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
        ended AS (SELECT conv_id, list_min([s0, s3]) AS s FROM walk WHERE i = n)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost,
               coalesce(s.a, '') AS audit, sha256(substr(coalesce(s.r, ''), 2)) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
