"""Neighbourhoods and shortest paths by breadth-first joins.

Each level is one join of the frontier with the edges. The frontier is written to the shared checkpoint folder, which
cuts the plan and survives lost executors, and its size is known then: a small one is broadcast, so that edges need
no shuffle; a large one is joined by shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Direction, SubGraph
from loomgraph.runtime import checkpointed

#: A frontier of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000


def adjacency(edges: DataFrame, direction: Direction | str = Direction.OUTGOING, kinds: Sequence[str] | None = None) -> DataFrame:
    """(here, there): where a step in the given direction leads."""
    direction = Direction(direction)
    used = edges.where(F.col("kind").isin(*kinds)) if kinds is not None else edges
    out = used.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = used.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return {Direction.OUTGOING: out, Direction.INCOMING: back, Direction.BOTH: out.unionByName(back)}[direction]


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def reach(edges: DataFrame, roots: DataFrame, direction: Direction | str = Direction.OUTGOING, depth: int = 1, kinds: Sequence[str] | None = None) -> DataFrame:
    """(root, id, depth): what walks of 1 to ``depth`` steps lead to from each root, with the least number of steps.

    ``roots`` has a column ``id``; all roots are followed in one traversal. Depth 0 is as depth 1. A root is not
    excluded: it is among its own neighbours where a walk leads back to it. Edges may repeat, so they need not be made
    distinct first; then a small frontier meets them where they are read.
    """
    steps = adjacency(edges, direction, kinds)
    frontier = checkpointed(roots.select(F.col("id").alias("root"), "id").distinct())
    rows = frontier.count()
    levels: list[DataFrame] = []
    seen, total = None, 0
    for level in range(1, max(depth, 1) + 1):
        ahead = steps.join(_small(frontier, rows), F.col("here") == F.col("id")).select("root", F.col("there").alias("id")).distinct()
        if seen is not None:
            ahead = ahead.join(_small(seen, total), ["root", "id"], "left_anti")
        new = ahead.withColumn("depth", F.lit(level))
        if level == max(depth, 1):  # the last level is left to the query that uses it
            levels.append(new)
            break
        new = checkpointed(new)
        rows = new.count()
        if not rows:
            break
        levels.append(new)
        frontier = new.select("root", "id")
        seen, total = (frontier if seen is None else seen.unionByName(frontier)), total + rows
    if not levels:
        return frontier.select("root", "id", F.lit(1).alias("depth")).limit(0)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def neighbors(symbols: DataFrame, edges: DataFrame, root: str, direction: Direction | str = Direction.OUTGOING, depth: int = 1, kinds: Sequence[str] | None = None, exclude_root: bool = False) -> DataFrame:
    """The symbols within ``depth`` steps of ``root``, with their depths. An unknown root has none."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], "id string")
    found = reach(edges, start, direction, depth, kinds).select("id", "depth")
    if exclude_root:
        found = found.where(F.col("id") != root)
    return symbols.join(found, "id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends both are among ``nodes`` (a column ``id``), once each."""
    ids = nodes.select("id").distinct()
    return (
        edges.select("source", "target", "kind")
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select("source", "target", "kind")
        .distinct()
    )


def subgraph(symbols: DataFrame, edges: DataFrame, root: str, direction: Direction | str = Direction.BOTH, depth: int = 1, kinds: Sequence[str] | None = None) -> SubGraph:
    """The neighbourhood of ``root`` and all edges among it and its neighbours, whatever their kinds."""
    nodes = checkpointed(neighbors(symbols, edges, root, direction, depth, kinds))
    own = edges.sparkSession.createDataFrame([(root,)], "id string")
    return SubGraph(nodes, induced(edges, nodes.select("id").unionByName(own)))


def in_order(nodes: DataFrame) -> DataFrame:
    """Nearest first; ties by name, file, line and id."""
    return nodes.orderBy("depth", "name", "file_path", "line_start", "id")


def shortest_path(edges: DataFrame, source: str, target: str, kinds: Sequence[str] | None = None, longest: int | None = None) -> DataFrame:
    """(trail): the ids of a shortest outgoing path from ``source`` to ``target``, or no row.

    Of equally short paths the one whose ids come first in order is taken. A node's first trail is the least of its
    level, so each node is visited once. From a node to itself the path has that node alone, with or without edges.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([([source],)], "trail array<string>")
    steps = adjacency(edges, Direction.OUTGOING, kinds)
    frontier = spark.createDataFrame([(source, [source])], "id string, trail array<string>")
    seen = frontier.select("id")
    rows, total, length = 1, 1, 0
    while rows and (longest is None or length < longest):
        ahead = steps.join(_small(frontier, rows), F.col("here") == F.col("id")).select(F.col("there").alias("id"), F.concat("trail", F.array("there")).alias("trail"))
        ahead = ahead.groupBy("id").agg(F.min("trail").alias("trail"))
        frontier = checkpointed(ahead.join(_small(seen, total), "id", "left_anti"))
        length += 1
        counts = frontier.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") == target, 1))).first()
        rows = counts[0]
        if counts[1]:
            return frontier.where(F.col("id") == target).select("trail")
        seen, total = seen.unionByName(frontier.select("id")), total + rows
    return frontier.select("trail").limit(0)


def chain(symbols: DataFrame, trail: DataFrame) -> DataFrame:
    """The symbols along a path, in order: (pos, id and the symbol's columns), null where a symbol is missing."""
    steps = trail.select(F.posexplode("trail").alias("pos", "id"))
    return steps.join(symbols, "id", "left").orderBy("pos")
