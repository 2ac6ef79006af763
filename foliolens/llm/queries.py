"""The operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import bm25_topk, decontamination, hilbert_sharding, ngram_jaccard_join, run_length_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_alignment, toxicity, training_order, url_reputation, vector_codes
from foliolens.llm.common import new_path, table
from foliolens.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.join_components(table(spark, sf_dir, "documents"), words=4, percent=85).drop("component", "text_hash")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = new_path(spark)
    secret_scan.update(docs, store)  # the first run of a new ledger: all texts are unseen
    found = secret_scan.by_path(docs, secret_scan.stored(spark, store))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_sharding.assign(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25_topk.top_k(docs, docs.filter("doc_id % 100 = 0"), k=10)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.sequences(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).alias("codebooks_sha256"))


def op12_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_hilbert_sharding": op4_hilbert_sharding,
    "op5_url_reputation": op5_url_reputation,
    "op6_bm25_topk": op6_bm25_topk,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece_codec": op9_sentencepiece_codec,
    "op10_training_order": op10_training_order,
    "op11_vector_codes": op11_vector_codes,
    "op12_run_length_dedup": op12_run_length_dedup,
    "op13_token_alignment": op13_token_alignment,
}
