"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe_matrix, jaccard_trie, language_id, line_dedup, media, packing, quality_knn, token_files, topk_pivot, url_reputation
from paperloom.llm.shared import crc_rest, new_path, written

BYTE_BPE = "byte_bpe_50k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_files.read_token_digests(spark, path)


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return url_reputation.verdicts(table(spark, sf_dir, "pages"), outcomes)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2, length=1024)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.md5("text").alias("text_md5"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs, crc_rest("doc_id", 4) != 2)
    own = docs.select("doc_id", "text", (crc_rest("doc_id", 4) == 2).alias("held_out"))
    return language_id.predict(own, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_pivot.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and landmarks are stored; row groups are small, as a landmark is kept for some ten bytes of text."""
    small = {"parquet.block.size": 16 << 20}
    stored = written(media.with_media(table(spark, sf_dir, "documents")), "media", **small)
    found = written(media.fingerprints(stored), "landmarks", **small)
    return found.withColumn("feature", F.concat_ws(":", F.size("landmarks"), F.hex(F.xxhash64("landmarks")))).drop("landmarks")


def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), crc_rest("doc_id", 5) != 0)
    scored = quality_knn.predict(docs.select("doc_id", "text", (crc_rest("doc_id", 5) == 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op9_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.similar_components(table(spark, sf_dir, "documents"), size=4, least=85)


def op10_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(MULTI_BPE)
    encoded = bpe_matrix.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe_matrix.digest(bpe_matrix.decode(encoded, path, public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_url_reputation, op3_best_fit_packing, op4_line_dedup, op5_language_id, op6_pivot_top_k, op7_media_columns, op8_quality_knn, op9_jaccard_trie, op10_byte_level_bpe)}

ORACLE_SQL: dict[str, str] = {"op2_url_reputation": url_reputation.oracle(), "op4_line_dedup": line_dedup.oracle(), "op6_pivot_top_k": topk_pivot.oracle(), "op9_jaccard_trie": jaccard_trie.oracle()}
