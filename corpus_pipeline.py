"""A training corpus from raw documents: five stages, each an operator of loomgraph.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm import bpe, exact, jaccard, mixture, quality
from loomgraph.llm.text import unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Pairs of id and digest that are made known to every worker at most.
BROADCAST_PAIRS = 300_000

#: Scratch tables of the stages so far.
_left: list[str] = []


def _staged(stage: Stage) -> Stage:
    """A stage that first drops the scratch tables of earlier ones: its ``docs`` have been written, so nothing reads
    those any more."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        runtime.drop_scratch(spark, _left)
        _left.clear()
        runtime.driver_gives_back(spark)  # frames of the stage before hold on to their plans until they are collected
        before = len(runtime.scratch_tables())
        out = stage(spark, docs, sf_dir)
        _left.extend(runtime.scratch_tables()[before:])
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def _without(docs: DataFrame, gone: DataFrame, twice: DataFrame, digest: Column) -> DataFrame:
    """``docs`` without the rows whose (doc_id, digest) ``gone`` has as (id, digest), and one row of those that
    ``twice`` has. Texts are shuffled only if there are more such pairs than may be broadcast."""
    id_, mark, kind = (unused(docs.columns, c) for c in ("gone_id", "gone_digest", "gone_kind"))
    marked = gone.select("id", "digest", F.lit("gone").alias("kind")).unionByName(twice.select("id", "digest", F.lit("twice").alias("kind")))
    marked = runtime.written(marked.distinct().select(F.col("id").alias(id_), F.col("digest").alias(mark), F.col("kind").alias(kind)), "pipeline-marked")
    few = marked.count() <= BROADCAST_PAIRS
    joined = docs.join(F.broadcast(marked) if few else marked, F.col("doc_id").eqNullSafe(F.col(id_)) & (digest == F.col(mark)), "left")
    left = joined.where(F.col(kind).isNull()).select(*_columns(docs))
    if marked.where(F.col(kind) == "twice").isEmpty():
        return left
    return left.unionAll(joined.where(F.col(kind) == "twice").dropDuplicates([id_, mark]).select(*_columns(docs)))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


@_staged
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Learned from the labelled documents among ``docs``.

    Each row is judged by its text: equal rows share a verdict; null and empty texts are judged by their statistics; ids
    may be null or repeated. Without labelled documents all stay. An empty table gives no rows. Other columns are
    carried along, whatever their names."""
    model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


@_staged
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id.

    Null and empty texts are equal. A null id is smaller than all others. Of rows that are equal in id and text one
    stays, any if they differ elsewhere. An empty table gives no rows. Other columns are carried along, whatever their
    names."""
    verdicts = runtime.written(exact.exact_dedup(docs.select("doc_id", "text")), "pipeline-exact")
    pairs = verdicts.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "kept")
    twice = pairs.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    digest = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    return _without(docs, pairs.where(~F.col("kept")), twice, digest)


@_staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the least id.

    A null id comes after all others; of rows of one id the one with the least hash of its text stays, and of rows that
    are equal in id and text one, any if they differ elsewhere. Documents without words are no duplicates of any. An
    empty table gives no rows. Other columns are carried along, whatever their names."""
    found = jaccard.jaccard_components(docs.select("doc_id", "text")).where("component_key is not null")
    found = runtime.written(found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("digest"), "component_key"), "pipeline-near")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")
    stays = found.groupBy("component_key").agg(F.min(order).alias("stays")).withColumnRenamed("component_key", "c")
    judged = found.join(stays, F.col("component_key") == F.col("c")).withColumn("kept", F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("digest") == F.col("stays.digest")))
    twice = judged.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    digest = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return _without(docs, judged.where("not kept"), twice, digest)


@_staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    A null source is a source of its own. Rows of equal id, or of equal text and no id, are taken alike. Documents without
    words cost nothing and are taken as their hash says. An empty table gives no rows. Other columns are carried along,
    whatever their names."""
    return mixture.repeated(docs)


@_staged
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: how many, their digest and that of the decoded bytes.

    Null and empty texts have no tokens; ids may be null or repeated, each row gives one. An empty table gives no rows.
    Other columns are ignored."""
    return bpe.encode(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mix_sources),
    ("encode", encode),
]

#: The classifier is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, writing each one's result to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
