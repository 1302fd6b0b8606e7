"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quotes import reply_order

    return reply_order(table(spark, sf_dir, "conversations"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pitman_yor import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.prefix_hash import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.ordinal import grade_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_documents(docs, table(spark, sf_dir, "labels")).drop("text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, passage=(256, 51)).drop("text")


QUERIES = {f.__name__: f for f in (op1_quotation_linking, op2_pitman_yor, op3_packing, op4_sharding, op5_byte_bpe, op6_prefix_hash, op7_ordinal_quality, op8_exact_dedup, op9_simhash, op10_suffix_dedup)}

ORACLE_SQL = {
    "op4_sharding": """
        WITH tab AS (
          SELECT list(c ORDER BY n) AS t FROM (
            SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
            FROM (SELECT unnest(range(256)) AS n))),
        s AS (
          SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, coalesce(text, '') AS t,
                 sum(coalesce(strlen(text), 0) + 1) OVER (ORDER BY doc_id) AS upto,
                 sum(coalesce(strlen(text), 0) + 1) OVER () AS total,
                 row_number() OVER (ORDER BY doc_id) AS n
          FROM documents),
        c AS (SELECT *, least(CAST(floor((2 * upto - size) * 16 / CAST(2 * total AS DOUBLE)) AS INTEGER), 15) AS shard FROM s)
        SELECT doc_id, CAST(size AS BIGINT) AS size,
               xor(4294967295::BIGINT, list_reduce(
                 list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(c.t)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                 lambda acc, b: xor(tab.t[(xor(acc, b) & 255) + 1], acc >> 8))) AS text_crc32,
               'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM c, tab""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
