"""File-level roll-ups and the views a graph viewer draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import extension, file_name


def file_nodes(symbols: DataFrame) -> DataFrame:
    """(file_path, name, ext, symbols): a node for each file."""
    counts = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))
    return counts.select("file_path", file_name(F.col("file_path")).alias("name"), F.coalesce(extension(F.col("file_path")), F.lit("")).alias("ext"), "symbols")


def file_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, target_file, kind, weight): how many edges lead from one file to another. Only the two columns
    needed of each symbol are joined, and the count is combined before its shuffle."""
    files = symbols.select("id", "file_path")
    return (
        edges.join(files.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source")
        .join(files.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target")
        .where("source_file <> target_file")
        .groupBy("source_file", "target_file", "kind")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def visible(symbols: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("function", "class"), exts: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given kinds and extensions, and the edges whose ends are both among them."""
    nodes = symbols.where(F.col("kind").isin(*kinds))
    if exts is not None:
        nodes = nodes.where(F.coalesce(extension(F.col("file_path")), F.lit("")).isin(*exts))
    ids = nodes.select("id")
    links = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, links.select("source", "target", "kind")


def node_size(count: Column) -> Column:
    """How large a node is drawn for so many symbols."""
    return F.least(F.lit(30.0), 4 + F.sqrt(count.cast("double")) * 2)


def highlighted(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose names contain ``query`` in any case."""
    return nodes.where(F.lower("name").contains(query.lower()))


def graph_json(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(view, part, json): a JSON object for each node and link of the symbol view and of the file view."""
    ids = symbols.select("id")
    known = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    lang = F.coalesce(extension(F.col("file_path")), F.lit("")).alias("lang")

    def rows(view: str, part: str, frame: DataFrame, *columns: Column | str) -> DataFrame:
        return frame.select(F.lit(view).alias("view"), F.lit(part).alias("part"), F.to_json(F.struct(*columns)).alias("json"))

    return (
        rows("symbols", "nodes", symbols, "id", "name", "kind", F.col("file_path").alias("file"), F.col("line_start").alias("line"), lang)
        .unionByName(rows("symbols", "links", known, "source", "target", "kind"))
        .unionByName(rows("files", "nodes", file_nodes(symbols), F.col("file_path").alias("id"), "name", F.col("ext").alias("lang"), "symbols"))
        .unionByName(rows("files", "links", file_links(symbols, edges), F.col("source_file").alias("source"), F.col("target_file").alias("target"), "kind", "weight"))
    )


def extension_census(paths: DataFrame, extensions: DataFrame) -> DataFrame:
    """(ext, files, lang, covered): how many files (a column ``path``) have each extension, and whether a registered
    language covers it."""
    counts = paths.select(extension(F.col("path")).alias("ext")).where("ext is not null").groupBy("ext").agg(F.count(F.lit(1)).alias("files"))
    return counts.join(extensions, "ext", "left").select("ext", "files", "lang", F.col("lang").isNotNull().alias("covered"))
