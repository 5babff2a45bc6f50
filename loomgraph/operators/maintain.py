"""Changes to the tables of a graph, as functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and ``old`` rows whose keys aren't among them. ``new`` has one row for each key."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """All edges, once each."""
    columns = ["source", "target", "kind"]
    return old.select(*columns).unionByName(new.select(*columns)).distinct()


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["path"])


def upsert_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["symbol_id", "source", "key"])


def delete_annotations(old: DataFrame, symbol_id: str, source: str) -> DataFrame:
    """All annotations but those that ``source`` has made of a symbol."""
    return old.where(~((F.col("symbol_id") == symbol_id) & (F.col("source") == source)))


def annotations_of(annotations: DataFrame, symbol_id: str) -> DataFrame:
    return annotations.where(F.col("symbol_id") == symbol_id)


def nested_annotations(annotations: DataFrame) -> DataFrame:
    """(symbol_id, json): a symbol's annotations as an object of sources, each an object of keys and values."""
    by_source = annotations.groupBy("symbol_id", "source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("entries"))
    gathered = by_source.groupBy("symbol_id").agg(F.collect_list(F.struct("source", "entries")).alias("all"))
    # maps have no order of their own: entries are put in the order of their sources
    ordered = F.array_sort("all", lambda a, b: F.when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0))
    return gathered.select("symbol_id", F.to_json(F.map_from_entries(ordered)).alias("json"))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Tables without anything of the files in ``paths`` (a column ``path``): their symbols, annotations of those,
    edges at either end, raw edges and file records."""
    gone = tables["symbols"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    out = dict(tables)
    out["symbols"] = tables["symbols"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*tables["symbols"].columns)
    if "edges" in tables:
        left = tables["edges"].join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
        out["edges"] = left.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*tables["edges"].columns)
    if "annotations" in tables:
        out["annotations"] = tables["annotations"].join(gone.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti").select(*tables["annotations"].columns)
    if "raw_edges" in tables:
        out["raw_edges"] = tables["raw_edges"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*tables["raw_edges"].columns)
    if "files" in tables:
        out["files"] = tables["files"].join(paths.select("path"), "path", "left_anti").select(*tables["files"].columns)
    return out


def changes(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or deleted, by content hash. Both sides have (path, content_hash)."""
    both = known.select("path", F.col("content_hash").alias("old")).join(found.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    status = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    )
    return both.select("path", status.alias("status"))


def stale(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path): files that may have changed: unknown ones, and those modified in or after the second in which they
    were indexed. ``found`` has (path, mtime). The content hash decides afterwards."""
    return found.join(files.select("path", "last_indexed"), "path", "left").where("last_indexed is null or mtime >= last_indexed").select("path")


def orphans(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no symbol: none, in a sound graph."""
    ids = symbols.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return edges.select("source", "target", "kind").join(known.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")
