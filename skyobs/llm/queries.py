"""The operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.llm import fingerprint, kneser_ney, language_id, mixing, sentencepiece_bpe, sharding, simhash, suffix_dedup, tiff, warc
from skyobs.llm.runtime import shared_folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = warc.write_and_read(pages, shared_folder(spark, "warc"))
    return back.select(F.col("number").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(_documents(spark, sf_dir), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classified(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_documents(spark, sf_dir))


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_rows(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprint, op2_warc, op3_sentencepiece, op4_quality, op5_suffix_array, op6_tiff, op7_simhash, op8_sharding, op9_language_id, op10_mixing)
}

ORACLE_SQL: dict[str, str] = {}
