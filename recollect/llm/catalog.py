"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import sentencepiece_roundtrip

    return sentencepiece_roundtrip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_roundtrip

    return warc_roundtrip(table(spark, sf_dir, "pages"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_secret_scan": op5_secret_scan,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256,
               CAST(n_points AS BIGINT) AS n_points
        FROM k""",
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages),
        b AS (
            SELECT *, unhex(hex) AS raw FROM p),
        bits AS (
            SELECT *, '0123456789abcdef' AS digits FROM b)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     CAST(1 + ((((strpos(digits, substr(hex, CAST((5 * i) // 4 + 1 AS INT), 1)) - 1) * 16
                        + (CASE WHEN (5 * i) // 4 + 2 <= 40 THEN strpos(digits, substr(hex, CAST((5 * i) // 4 + 2 AS INT), 1)) - 1 ELSE 0 END))
                       >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM bits""",
}
