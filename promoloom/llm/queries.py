"""Named queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, bpe, conversations, decontaminate, exact_dedup, language, mixing, near_dedup, pii,
               quality, secret_scan, token_counts, vectors)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))
    return found.select("doc_id", *[pii.count_kind(k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.as_text(pii.only(pii.BASE)), 256).alias("base_sha256"),
                        pii.as_text(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                            digests=True)


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"), size=2)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    return found.select("doc_id", *[pii.count_kind(k, "base").alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
                        pii.as_text(F.col("spans")).alias("spans"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.repair(rows).withColumnRenamed("key", "conv_id")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_quality, op3_bpe, op4_near_vectors, op5_token_counts, op6_near_dedup,
              op7_exact_dedup, op8_language, op9_secrets, op10_mixing, op11_decontaminate, op12_conversations,
              op13_alignment)
}

SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op4_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
                   coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                            AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good FROM embeddings),
        u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE good),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b
                 ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        reach AS (SELECT x, x AS y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
        low AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
        many AS (SELECT x, count(*) AS n FROM link GROUP BY x)
        SELECT vec_id, coalesce(many.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN low ON low.x = vec_id LEFT JOIN many ON many.x = vec_id
    """,
    "op6_near_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 2 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM t),
        n AS (SELECT doc_id, len(g) AS n FROM s),
        one AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
                 FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
        link AS (SELECT a, b FROM met WHERE 100 * i >= 80 * (na + nb - i)),
        way AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT x, x AS y FROM way UNION SELECT reach.x, way.y FROM reach JOIN way ON way.x = reach.y),
        low AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
        SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
        FROM n LEFT JOIN low ON x = doc_id
    """,
    "op11_decontaminate": r"""
        WITH item AS (
            SELECT item_id::VARCHAR AS item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
        doc AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
        gram AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
                 FROM place, (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= len(w)),
        hit AS (SELECT r, i, gram.k, item_id FROM gram JOIN win USING (k, g)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
        found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
                  FROM hit GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (r) LEFT JOIN found USING (r)
    """,
    # The checksum is taken bit by bit; the repair is a recursion over rows that keeps, in each state, the least (cost, audit).
    "op12_conversations": r"""
        WITH RECURSIVE marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id
            FROM conversations),
        summed AS (
            SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, range(0, 8 * length(id))),
                lambda a, j: xor(xor(a, CASE WHEN j % 8 = 0 THEN ascii(id[(j // 8 + 1)::INT])::BIGINT ELSE 0 END) >> 1,
                                 3988292384 * (xor(a, CASE WHEN j % 8 = 0 THEN ascii(id[(j // 8 + 1)::INT])::BIGINT ELSE 0 END) & 1)))) % 20 AS mark
            FROM marked),
        live AS (
            SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
                   CASE mark WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE WHEN mark = 3 THEN [0, 1] ELSE [0] END) FROM summed) WHERE mark <> 0),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
            FROM live),
        line AS (
            SELECT *, left(role, 1) AS c,
                   CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault
            FROM placed),
        fact AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM line) GROUP BY conv_id),
        -- Edits of a row in a state: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; at most one turn is inserted before it.
        edit AS (SELECT * FROM (VALUES
            (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3),
            (0, '', 'R', 2), (1, '', 'R', 2), (3, '', 'R', 2), (2, '', 'R', 3),
            (0, '', 'D', 0), (1, '', 'D', 1), (2, '', 'D', 2), (3, '', 'D', 3)) AS t(state, c, e, becomes)),
        gap AS (SELECT * FROM (VALUES
            (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
            (0, 2, 'I', 'user:'), (1, 2, 'I', 'user:'), (3, 2, 'I', 'user:'), (2, 3, 'I', 'assistant:')) AS t(state, becomes, ins, said)),
        way AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM fact
            UNION ALL
            SELECT way.conv_id, line.i, edit.becomes,
                   min({'cost': best.cost + 5 * length(ins) + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
                                + CASE WHEN fault = 't' AND e <> 'D' THEN 5 ELSE 0 END,
                        'audit': best.audit || ins || e,
                        'said': best.said || CASE WHEN ins = 'I' THEN [gap.said] ELSE [] END
                                || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                                          ELSE [CASE edit.becomes WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END})
            FROM way JOIN line ON line.conv_id IS NOT DISTINCT FROM way.conv_id AND line.i = way.i + 1
            JOIN gap ON gap.state = way.state
            JOIN edit ON edit.state = gap.becomes AND (edit.c = '' OR edit.c = line.c) AND (e = 'D' OR fault IN ('f', 't'))
            GROUP BY way.conv_id, line.i, edit.becomes),
        done AS (
            SELECT way.conv_id, min({'cost': best.cost + 5 * length(ins), 'audit': best.audit || ins,
                                     'said': best.said || CASE WHEN ins = 'I' THEN [gap.said] ELSE [] END}) AS best
            FROM way JOIN fact ON fact.conv_id IS NOT DISTINCT FROM way.conv_id AND fact.n = way.i
            JOIN gap ON gap.state = way.state AND gap.becomes IN (0, 3)
            GROUP BY way.conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN fact ON fact.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
