"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholarmill.llm import decontamination, idpacking, linededup, neardup, packing, pii, quality, secrets, sharding, tokens
from scholarmill.session import table

#: Bytes of text in a shard at most.
SHARD_BYTES = 2 << 20


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of")


def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(table(spark, sf_dir, "documents")).drop("mark")


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(table(spark, sf_dir, "documents"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idpacking.pack_ids(table(spark, sf_dir, "documents"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_extendible_sharding": sharding_query,
    "op2_simhash_neardup": near_duplicates,
    "op3_decontamination": contamination,
    "op4_genetic_packing": genetic_packing,
    "op5_pii_crf": personal_data,
    "op6_token_counts": token_counts,
    "op7_fuzzy_line_dedup": line_duplicates,
    "op8_packed_ids": packed_ids,
    "op9_line_quality": line_quality,
    "op10_secrets": secret_scan,
}

SQL = {
    "op1_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits
  FROM documents),
level AS (
  SELECT bits, depth, bits >> (60 - depth) AS prefix
  FROM (SELECT DISTINCT bits FROM d), (SELECT unnest(range(61)) AS depth)),
bucket AS (
  SELECT l.depth, l.prefix, sum(d.n_bytes) AS n_bytes, count(DISTINCT d.bits) AS n_keys
  FROM d JOIN level l USING (bits) GROUP BY 1, 2),
leaf AS (
  SELECT l.bits, min(l.depth) AS depth FROM level l JOIN bucket b ON l.depth = b.depth AND l.prefix = b.prefix
  WHERE b.n_bytes <= {SHARD_BYTES} OR b.n_keys = 1 OR b.depth = 60 GROUP BY 1)
SELECT d.doc_id, d.n_bytes, CAST(leaf.depth AS INTEGER) AS shard_depth,
       CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(d.bits >> (60 - leaf.depth)), CAST(leaf.depth AS INTEGER), '0') END AS shard_id
FROM d JOIN leaf USING (bits)
""",
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op9_line_quality": quality.ORACLE_SQL,
}
