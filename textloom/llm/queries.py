"""The queries over the driver's tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, bpe, common, embeddings, hmm, langid, merkle, mixing, packing, paragraphs, quality, sharding, simhash, urls

#: The rules of op7.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return hmm.score_documents(docs, common.crc32_text(F.col("doc_id")) % 10 == 0)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(common.read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(common.read(spark, sf_dir, "documents"), [1.0] * 8)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents")).drop("key")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(common.read(spark, sf_dir, "documents")).drop("row_key")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(action, host, path)")
    return urls.judge_urls(common.read(spark, sf_dir, "pages"), rules)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(common.crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(common.read(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bitsliced.build_index(common.read(spark, sf_dir, "documents"))
    return bitsliced.search(index, common.read(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.public_vocabulary()
    made = bpe.decode(bpe.encode(common.read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(common.read(spark, sf_dir, "documents"))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), ""), 256)
    tampered = F.coalesce(common.crc32_text(F.col("doc_id")) % 2 == 0, F.lit(False))
    made = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), merkle.folded(F.when(tampered, F.col("changed")).otherwise(F.col("leaf")), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm_scores, op2_quality_rules, op3_sharding, op4_mixing, op5_best_fit_packing, op6_substring_dedup, op7_url_filters, op8_language_id, op9_embedding_near_dedup, op10_simhash_near_dedup, op11_bit_sliced_search, op12_byte_bpe, op13_merkle_manifest)}
