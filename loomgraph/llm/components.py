"""Connected components of a graph given by its edges, in a logarithmic number of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import checkpointed, lean, workers_can_import

#: Edges that one task contracts.
TASK_EDGES = 500_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and for each the least that can be reached.

    Each round hooks roots to their least neighbouring root, which halves those that have neighbours at least."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (u, v), u larger, of the same components: each of ``tasks`` tasks makes one star of each component of its edges."""
    workers_can_import(edges.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            node, least = least_reached(*(np.concatenate(c) for c in zip(*held)))
            apart = node != least
            yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(least[apart])], ["u", "v"])

    return edges.repartition(tasks).mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of an edge (a, b) of longs.

    Tasks first contract the edges that they hold, TASK_EDGES each, to stars; if one task holds all, these are the answer.
    Else two steps alternate until nothing changes. The large step hooks a node's larger neighbours to its least
    neighbour; the small step hooks its smaller neighbours and itself to it. Every edge stays one row, so a node with
    any number of neighbours costs no more than its edges, and the graph ends as one star for each component.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    contracted = _contracted(edges, tasks)
    now = checkpointed(contracted.distinct() if tasks > 1 else contracted)
    mark = _mark(now) if tasks > 1 else (0,)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # rows point from larger to smaller: the least smaller neighbour of u takes u and all of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
