"""Composite queries: a symbol's context, a file's dependents, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import lines_of, snippet
from loomgraph.model import Context, Direction
from loomgraph.operators.search import exact
from loomgraph.operators.traverse import induced, reach, shortest_path
from loomgraph.runtime import checkpointed

_ORDER = ["depth", "name", "file_path", "line_start", "id"]


def with_snippets(symbols: DataFrame, sources: DataFrame, context_lines: int = 2) -> DataFrame:
    """Symbols with the lines of their files, from ``sources`` (path, text): empty where the file is missing. Each
    file is split once, and only files that hold one of the symbols."""
    texts = sources.select(F.col("path").alias("file_path"), "text").join(symbols.select("file_path").distinct(), "file_path", "left_semi")
    split = texts.select("file_path", lines_of(F.col("text")).alias("__lines"))
    lines = F.coalesce("__lines", F.array().cast("array<string>"))
    return symbols.join(split, "file_path", "left").withColumn("snippet", snippet(lines, F.col("line_start"), F.col("line_end"), context_lines)).drop("__lines")


def context(symbols: DataFrame, edges: DataFrame, sources: DataFrame | None, name: str, depth: int = 2, context_lines: int = 2, limit: int | None = None, exclude_root: bool = False) -> Context | None:
    """The symbol of exactly this name, its neighbours either way, nearest first and at most ``limit``, and the edges
    among them all. None if no symbol has the name."""
    root = checkpointed(exact(symbols, name))
    row = root.first()
    if row is None:
        return None
    found = reach(edges, root.select("id"), Direction.BOTH, depth).select("id", "depth")
    if exclude_root:
        found = found.where(F.col("id") != row["id"])
    near = symbols.join(found, "id")
    if limit is not None:
        near = near.orderBy(*_ORDER).limit(limit)
    near = checkpointed(near)
    among = induced(edges, near.select("id").unionByName(root.select("id")))
    none = F.lit("").alias("snippet")
    if sources is None:
        return Context(root.select("*", none), near.select("*", none), among)
    return Context(with_snippets(root, sources, context_lines), with_snippets(near, sources, context_lines), among)


def named_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the names of their ends, ``?`` where a symbol is missing."""
    names = symbols.select("id", "name")
    return (
        edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("__from")), "source", "left")
        .join(names.select(F.col("id").alias("target"), F.col("name").alias("__to")), "target", "left")
        .select("source", "target", "kind", F.coalesce("__from", F.lit("?")).alias("source_name"), F.coalesce("__to", F.lit("?")).alias("target_name"))
    )


def dependents(symbols: DataFrame, edges: DataFrame, path: str, depth: int = 1, limit: int | None = None, sources: DataFrame | None = None, context_lines: int = 2) -> DataFrame:
    """What leads to each symbol of a file that isn't a module: (root, root_name, depth, rank and the symbol's
    columns), at most ``limit`` for each root. Roots that nothing leads to give no row. One traversal serves all
    symbols of the file."""
    roots = symbols.where((F.col("file_path") == path) & (F.col("kind") != "module")).select("id", "name")
    found = reach(edges, roots, Direction.INCOMING, depth)
    best = Window.partitionBy("root").orderBy(*_ORDER)
    ranked = symbols.join(found, "id").withColumn("rank", F.row_number().over(best))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    out = ranked.join(roots.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root")
    return out if sources is None else with_snippets(out, sources, context_lines)


def chain_between(symbols: DataFrame, edges: DataFrame, source_name: str, target_name: str, kinds: list[str] | None = None) -> DataFrame | None:
    """(trail) of the shortest path between two symbols given by exact name; None if a name is unknown."""
    ends = [exact(symbols, n).first() for n in (source_name, target_name)]
    if any(e is None for e in ends):
        return None
    return shortest_path(edges, ends[0]["id"], ends[1]["id"], kinds)


def status(symbols: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, branch, symbols, edges, indexed) of every configured repository (a column ``repo``), with whole counts."""
    s = symbols.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("symbols"))
    e = edges.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("edges"))
    counts = s.join(e, ["repo", "branch"], "left")
    return repos.select("repo").join(counts, "repo", "left").select(
        "repo", "branch", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("edges", F.lit(0)).alias("edges"), F.col("symbols").isNotNull().alias("indexed")
    )


def status_rollup(symbols: DataFrame) -> DataFrame:
    """Symbol counts by repository and kind, with subtotals (null kind) and the total (null repo)."""
    return symbols.rollup("repo", "kind").agg(F.count(F.lit(1)).alias("symbols"))
