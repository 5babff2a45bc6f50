"""Edges between repositories, and references that no repository answers yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.traverse import reach

EDGE_KEY = ["source_repo", "source_branch", "source_symbol", "target_repo", "target_branch", "target_symbol", "kind"]


def unresolved_id() -> Column:
    return F.md5(F.concat_ws("\0", "source_repo", "source_branch", "source_symbol", "target_package", "target_path", "kind"))


def _named(path: Column) -> tuple[Column, Column]:
    """The last part of a dotted, slashed or ``::`` path, and the rest as a path of folders."""
    parts = F.split(F.regexp_replace(path, r"::|[./\\]", "/"), "/")
    return F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def answers(references: DataFrame, deps: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cross edges, unresolved): what references to other packages lead to.

    ``references`` has (source_repo, source_branch, source_symbol, target_package, target_path, kind), ``deps``
    (package, repo), ``symbols`` (repo, branch, id, name, file_path). A reference is answered by a symbol of the
    package's repository whose name is the path's last part and whose file's path contains the rest; of several the
    last by file, branch and id. The same rule serves imports of a repository just indexed and references that waited for
    one, so the order in which repositories are indexed doesn't matter.
    """
    name, module = _named(F.col("target_path"))
    asked = references.withColumns({"__name": name, "__module": module}).join(deps.select(F.col("package").alias("target_package"), F.col("repo").alias("target_repo")), "target_package", "left")
    offered = symbols.select(F.col("repo").alias("target_repo"), F.col("branch").alias("target_branch"), F.col("id").alias("target_symbol"), F.col("name").alias("__name"), "file_path")
    keys = ["source_repo", "source_branch", "source_symbol", "target_package", "target_path", "kind"]
    fits = asked.join(offered, ["target_repo", "__name"]).where(F.col("file_path").contains(F.col("__module")))
    best = fits.groupBy(*keys, "target_repo").agg(F.max_by(F.struct("target_branch", "target_symbol"), F.struct("file_path", "target_branch", "target_symbol")).alias("t"))
    edges = best.select("source_repo", "source_branch", "source_symbol", "target_repo", F.col("t.target_branch").alias("target_branch"), F.col("t.target_symbol").alias("target_symbol"), "kind").distinct()
    rest = references.select(*keys).distinct().join(best.select(*keys), keys, "left_anti")
    return edges, rest


def reconciled(edges: DataFrame, unresolved: DataFrame, deps: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross edges and unresolved references after a repository was indexed: waiting references are answered anew."""
    new, rest = answers(unresolved, deps, symbols)
    return edges.select(*EDGE_KEY).unionByName(new.select(*EDGE_KEY)).distinct(), rest


def invalidated(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cross edges whose targets still exist, and those whose targets have vanished."""
    known = symbols.select(F.col("repo").alias("target_repo"), F.col("branch").alias("target_branch"), F.col("id").alias("target_symbol"))
    keys = ["target_repo", "target_branch", "target_symbol"]
    return edges.join(known, keys, "left_semi").select(*EDGE_KEY), edges.join(known, keys, "left_anti").select(*EDGE_KEY)


def of_source(edges: DataFrame, repo: str, branch: str) -> DataFrame:
    return edges.where((F.col("source_repo") == repo) & (F.col("source_branch") == branch))


def of_target(edges: DataFrame, repo: str, branch: str) -> DataFrame:
    return edges.where((F.col("target_repo") == repo) & (F.col("target_branch") == branch))


def to_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Cross edges to the given symbols (repo, branch, id)."""
    return invalidated(edges, symbols)[0]


def without_repo(edges: DataFrame, repo: str, branch: str) -> DataFrame:
    """Cross edges but those from a repository's branch."""
    return edges.where(~((F.col("source_repo") == repo) & (F.col("source_branch") == branch)))


def waiting_for(unresolved: DataFrame, package: str) -> DataFrame:
    return unresolved.where(F.col("target_package") == package)


def unresolved_by_package(unresolved: DataFrame) -> DataFrame:
    """(target_package, references, sources): how many references wait for each package, from how many symbols."""
    return unresolved.groupBy("target_package").agg(
        F.count(F.lit(1)).alias("references"), F.countDistinct("source_repo", "source_branch", "source_symbol").alias("sources")
    )


def _node(repo: str, branch: str, symbol: str) -> Column:
    return F.concat_ws("\0", F.col(repo), F.col(branch), F.col(symbol))


def impact(edges: DataFrame, cross: DataFrame, repo: str, branch: str, symbol: str, depth: int = 2) -> DataFrame:
    """(repo, branch, symbol, depth): everything that leads to a symbol within ``depth`` steps, across repositories.
    ``edges`` has (repo, branch, source, target, kind)."""
    own = edges.select(_node("repo", "branch", "source").alias("source"), _node("repo", "branch", "target").alias("target"), "kind")
    far = cross.select(_node("source_repo", "source_branch", "source_symbol").alias("source"), _node("target_repo", "target_branch", "target_symbol").alias("target"), "kind")
    root = edges.sparkSession.createDataFrame([("\0".join((repo, branch, symbol)),)], "id string")
    found = reach(own.unionByName(far), root, "incoming", depth)
    parts = F.split("id", "\0")
    return found.select(parts[0].alias("repo"), parts[1].alias("branch"), parts[2].alias("symbol"), "depth")
