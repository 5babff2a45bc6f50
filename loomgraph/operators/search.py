"""Symbol search and point lookups."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import matches

#: Rows that a search returns at most.
LIMIT = 100


def search(symbols: DataFrame, query: str, kind: str | None = None, limit: int | None = LIMIT, literal: bool = False) -> DataFrame:
    """Symbols whose names contain ``query``: exact matches first, then by name; ties by file, line and id."""
    found = symbols.where(matches(F.col("name"), query, literal))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    found = found.orderBy(F.when(F.col("name") == query, 0).otherwise(1), "name", "file_path", "line_start", "id")
    return found if limit is None else found.limit(limit)


def search_repos(symbols: DataFrame, query: str, kind: str | None = None, limit: int = LIMIT, repo: str | None = None) -> DataFrame:
    """search() in every repository at once: at most ``limit`` rows of each, or of ``repo`` alone."""
    found = symbols if repo is None else symbols.where(F.col("repo") == repo)
    found = found.where(matches(F.col("name"), query))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    best = Window.partitionBy("repo").orderBy(F.when(F.col("name") == query, 0).otherwise(1), "name", "file_path", "line_start", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def exact(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of exactly this name, or no row."""
    return symbols.where(F.col("name") == name).orderBy("file_path", "line_start", "id").limit(1)


def symbol(symbols: DataFrame, id: str) -> DataFrame:
    return symbols.where(F.col("id") == id)


def file_symbols(symbols: DataFrame, path: str, modules: bool = True) -> DataFrame:
    """The symbols of a file by line, with or without module symbols."""
    found = symbols.where(F.col("file_path") == path)
    return (found if modules else found.where(F.col("kind") != "module")).orderBy("line_start", "id")


def file_record(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def repo_path(root: str, path: str) -> str:
    """A path as symbols carry it: relative to the repository's root."""
    p = PurePosixPath(path)
    return str(p.relative_to(root)) if p.is_absolute() and p.is_relative_to(root) else str(p)
