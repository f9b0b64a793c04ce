"""The queries of the corpus operators, with SQL where SQL can state them.

No SQL is given where it cannot: checksums of texts (1, 10), tokenizers (2, 10), rolling
and band hashes (3, 5), and learnt models (7, 8, 9). Those are tested against
brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, divergence, embdedup, langid, linededup, minhash, packing, secrets, sharding, topk, toxicity, turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_minhash(spark, sf_dir):
    return minhash.near_query(table(spark, sf_dir, "documents"))


def op4_topk(spark, sf_dir):
    return topk.search_query(table(spark, sf_dir, "embeddings"))


def op5_lines(spark, sf_dir):
    return linededup.line_query(table(spark, sf_dir, "documents"))


def op6_vectors(spark, sf_dir):
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark, sf_dir):
    return secrets.secret_query(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return langid.language_query(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_decontamination(spark, sf_dir):
    return decontam.decontamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark, sf_dir):
    return divergence.divergence_query(table(spark, sf_dir, "documents"))


def op13_turns(spark, sf_dir):
    return turns.repair_query(table(spark, sf_dir, "conversations"))


OPERATORS = (op1_shard, op2_bpe, op3_minhash, op4_topk, op5_lines, op6_vectors, op7_secrets, op8_language, op9_toxicity, op10_packing, op11_decontamination, op12_divergence, op13_turns)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {
    "op4_topk": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
    """,
    "op6_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), r(vec_id, reach) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reach = l.a
        )
        SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id) c USING (vec_id)
    """,
    "op11_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
        ), i AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM benchmark
        ), m AS (
            SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0
        ), b AS (
            SELECT DISTINCT n, item, array_to_string(w[a : a + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS a FROM m)
        ), h AS (
            SELECT r, n, a, win FROM (SELECT r, n, a, array_to_string(w[a : a + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM m))) x
            WHERE EXISTS (SELECT 1 FROM b WHERE b.n = x.n AND b.win = x.win)
        ), hit AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM h) GROUP BY r
        ), items AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h JOIN b USING (n, win)) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
        ), t AS (
            SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
        ), k AS (
            SELECT lang, term, sum(n) AS total FROM t GROUP BY lang, term HAVING count(*) >= 10
        ), v AS (
            SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS big FROM k GROUP BY lang
        ), c AS (
            SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
        ), g AS (
            SELECT lang, source, coalesce(sum(n), 0) AS nn FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.nn + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (v.big + 2 * v.v) AS q
            FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
        )
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        QUALIFY part = 'pair' OR rank <= 10
    """,
    "op13_turns": r"""
        WITH RECURSIVE o AS (
            SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc
            FROM conversations
        ), d AS (
            SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, xor(crc, 4294967295) % 20 AS h FROM o), (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)
        ), m AS (
            SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
                right(regexp_replace(text, '[ \t\n\x0b\x0c\r]+$', ''), 1) AS stop FROM d
        ), f AS (
            SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY c, role, text) THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) || left(role, 1) AS two FROM m
        ), counts AS (
            SELECT c, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
        ), solved AS (
            SELECT c, n + 1 AS pos, {'k': 0::BIGINT, 'e': ''} AS v0, {'k': 4::BIGINT, 'e': 'II'} AS v1, {'k': 2::BIGINT, 'e': 'I'} AS v2, {'k': 0::BIGINT, 'e': ''} AS v3 FROM counts
            UNION ALL
            SELECT c, pos, list_min([b0, {'k': 2 + b2.k, 'e': 'I' || b2.e}, {'k': 4 + b3.k, 'e': 'II' || b3.e}]), list_min([b1, {'k': 2 + b2.k, 'e': 'I' || b2.e}, {'k': 4 + b3.k, 'e': 'II' || b3.e}]),
                list_min([b2, {'k': 2 + b3.k, 'e': 'I' || b3.e}]), list_min([b3, {'k': 2 + b2.k, 'e': 'I' || b2.e}])
            FROM (
                SELECT s.c, f.pos,
                    list_min([{'k': 3 + v0.k, 'e': 'D' || v0.e}, {'k': CASE WHEN gone OR i <> 's' THEN 1000000000000 ELSE cut + v1.k END, 'e': 'K' || v1.e}, {'k': CASE WHEN gone OR i <> 'u' THEN 1000000000000 ELSE cut + v2.k END, 'e': 'K' || v2.e}, {'k': CASE WHEN gone THEN 1000000000000 ELSE 2 + cut + v2.k END, 'e': 'R' || v2.e}]) AS b0,
                    list_min([{'k': 3 + v1.k, 'e': 'D' || v1.e}, {'k': CASE WHEN gone OR i <> 'u' THEN 1000000000000 ELSE cut + v2.k END, 'e': 'K' || v2.e}, {'k': CASE WHEN gone THEN 1000000000000 ELSE 2 + cut + v2.k END, 'e': 'R' || v2.e}]) AS b1,
                    list_min([{'k': 3 + v2.k, 'e': 'D' || v2.e}, {'k': CASE WHEN gone OR i <> 'a' THEN 1000000000000 ELSE cut + v3.k END, 'e': 'K' || v3.e}, {'k': CASE WHEN gone THEN 1000000000000 ELSE 2 + cut + v3.k END, 'e': 'R' || v3.e}]) AS b2,
                    list_min([{'k': 3 + v3.k, 'e': 'D' || v3.e}, {'k': CASE WHEN gone OR i <> 'u' THEN 1000000000000 ELSE cut + v2.k END, 'e': 'K' || v2.e}, {'k': CASE WHEN gone THEN 1000000000000 ELSE 2 + cut + v2.k END, 'e': 'R' || v2.e}]) AS b3
                FROM solved s JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INTEGER) AS cut FROM f) f ON f.c = s.c AND f.pos = s.pos - 1
            )
        ), audit AS (
            SELECT c, v0.k AS cost, v0.e AS audit FROM solved WHERE pos = 1
        ), steps AS (
            SELECT c, pos, edit, sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY c ORDER BY pos) AS row_pos, sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY c ORDER BY pos) - 1 AS place
            FROM (SELECT c, unnest(range(1, len(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS edit FROM audit WHERE audit <> '')
        ), made AS (
            SELECT steps.c, steps.pos, edit, place, f.role, CASE edit WHEN 'I' THEN '' ELSE f.text END AS text, max(CAST(edit = 'K' AND place = 0 AND f.i = 's' AS INTEGER)) OVER (PARTITION BY steps.c) AS led
            FROM steps LEFT JOIN f ON f.c = steps.c AND f.pos = steps.row_pos WHERE edit <> 'D'
        ), hashed AS (
            SELECT c, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS repaired_sha256 FROM made GROUP BY c
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT c, conv_id FROM o) LEFT JOIN counts USING (c) LEFT JOIN audit USING (c) LEFT JOIN hashed USING (c)
    """,
}
