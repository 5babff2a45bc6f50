"""The registered queries of this subpackage and, where SQL can express them, the SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bm25, bpe, exact, jaccard, mixture, phrases, quality, sharding, suffixes, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_documents(spark, sf_dir))


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return bm25.search(docs, docs.where("doc_id % 100 = 0"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_dedup(_documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir)).drop("source")


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_dedup(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir)).drop("text_hash", "component_key")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(_documents(spark, sf_dir), str(path), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixture": op1_mixture,
        "op2_bm25": op2_bm25,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_sharding": op4_sharding,
        "op5_phrase_dedup": op5_phrase_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality": op7_quality,
        "op8_warc": op8_warc,
        "op9_jaccard": op9_jaccard,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixture": mixture.ORACLE,
        "op2_bm25": bm25.ORACLE,
        "op3_substring_dedup": suffixes.ORACLE,
        "op4_sharding": sharding.ORACLE,
        "op5_phrase_dedup": phrases.ORACLE,
        "op6_exact_dedup": exact.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_jaccard": jaccard.ORACLE,
    }
