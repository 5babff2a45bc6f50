"""Exact nearest neighbours of vectors, and retrieval that combines them with the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.maintain import upsert
from loomgraph.operators.traverse import reach
from loomgraph.runtime import checkpointed


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; null if a length is zero or lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "id") -> DataFrame:
    """(id, similarity): the k most similar vectors, ties by id. Every vector is compared; each task keeps its own k
    best, so no more than that is gathered."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), cosine(F.col("embedding"), wanted).alias("similarity")).orderBy(F.col("similarity").desc_nulls_last(), id_col).limit(k)


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"])


def delete_vectors(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti")


def combined(structural: DataFrame, semantic: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """(id, score): both rankings (id, rank) merged by the sum of reciprocal ranks, best first, ties by id."""
    both = structural.select("id", "rank").unionByName(semantic.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def semantic_context(symbols: DataFrame, edges: DataFrame, vectors: DataFrame, query: Sequence[float], k: int = 10, depth: int = 1) -> DataFrame:
    """The k symbols whose vectors are most similar to ``query``, and what surrounds them within ``depth`` steps either
    way: the symbols' columns, depth (0 for the k themselves) and similarity (null for the rest)."""
    seeds = checkpointed(nearest(vectors, query, k))
    near = reach(edges, seeds.select("id"), "both", depth).select("id", "depth").join(seeds, "id", "left_anti").groupBy("id").agg(F.min("depth").alias("depth"))
    found = seeds.select("id", F.lit(0).alias("depth"), "similarity").unionByName(near.select("id", "depth", F.lit(None).cast("double").alias("similarity")))
    return symbols.join(found, "id")
