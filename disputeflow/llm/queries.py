"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from disputeflow.llm import (
    bpe,
    chaining,
    decontamination,
    fingerprints,
    hard_negatives,
    near_dedup,
    quality,
    quality_rules,
    suffix_dedup,
    tokenizer_alignment,
    toxicity,
    url_filter,
    warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.public_ranks()
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, bpe.PATTERN)
    decoded = bpe.decode(encoded.drop("text"), ranks)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op7_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("part", "spans")


def op8_naive_bayes_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(quality_rules.ledger(docs))


def op11_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label=label)


def op12_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.aligned(table(spark, sf_dir, "documents"))


def op13_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


ORACLES = {
    "op11_four_russians_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
                   CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM p WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT p.anchor_id, q.other AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, q.other ORDER BY p.score DESC, p.other) AS INTEGER) AS rank,
               p.other AS negative_id, q.score AS positive_score, p.score AS negative_score
        FROM p JOIN positives q USING (anchor_id)
        WHERE NOT p.alike AND 30 * q.score <= 100 * p.score AND 100 * p.score <= 90 * q.score
        QUALIFY rank <= 10
    """,
    "op1_warc_chunked_records": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < p.page_id THEN f.first END AS refers_to,
               true AS intact
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
    """,
    "op7_fm_index_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), phrases AS (
            SELECT DISTINCT item_id, least(13, len(words)) AS width,
                   array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS phrase
            FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
                  FROM b WHERE len(words) > 0)
        ), widths AS (
            SELECT DISTINCT width FROM phrases
        ), windows AS (
            SELECT doc_id, width, i, array_to_string(words[i:i + width - 1], ' ') AS phrase
            FROM (SELECT doc_id, width, words, unnest(range(1, len(words) - width + 2)) AS i
                  FROM d, widths WHERE len(words) >= width)
        ), found AS (
            SELECT doc_id, w.width, i, item_id FROM windows w JOIN phrases p ON w.phrase = p.phrase AND w.width = p.width
        ), hit AS (
            SELECT doc_id, count(DISTINCT place) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_rule_ledger": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
        ), again AS (
            SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM windows JOIN again USING (doc_id, w), (SELECT unnest(range(5)) AS k)
            GROUP BY doc_id
        ), m AS (
            SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) AS BIGINT) AS n_lines,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
            FROM d LEFT JOIN covered c USING (doc_id)
        ), b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
                   + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
                   + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 4 ELSE 0 END)
                   + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 8 ELSE 0 END)
                   + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
                   + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failure_bits
            FROM m
        )
        SELECT *, failure_bits = 0 AS kept, CAST(2 AS INTEGER) AS policy_version FROM b
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
