"""Indexing: from a checkout to a committed snapshot, whole or incremental."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Config, Repo, current_branch
from loomgraph.operators.maintain import changes, stale
from loomgraph.runtime import checkpointed
from loomgraph.sources.extract import parse_files, tables
from loomgraph.sources.files import collect_files, read_files
from loomgraph.sources.languages import Registry
from loomgraph.store import Store, refreshed


@dataclass(frozen=True)
class Indexed:
    """What a run of indexing has done."""

    version: int
    files: int
    skipped: int
    deleted: int
    symbols: int
    raw_edges: int
    edges: int
    errors: int


def open_store(spark: SparkSession, data: str, config: Config, repo: Repo, branch: str | None = None) -> Store:
    return Store(spark, data, config.organization.name, repo.name, branch or current_branch(repo.root))


def index(spark: SparkSession, store: Store, repo: Repo, registry: Registry, force: bool = False) -> Indexed:
    """Bring a store up to date with a checkout. Unchanged files, by content hash, aren't parsed again unless
    ``force``."""
    if force:
        store.drop()
    paths = collect_files(repo.root, repo.include, repo.exclude)
    found = checkpointed(read_files(spark, repo.root, paths))
    return index_files(store, found, registry)


def index_files(store: Store, found: DataFrame, registry: Registry) -> Indexed:
    """index() for files (path, text, content_hash, status) from anywhere: all files that there are now."""
    spark = found.sparkSession
    old = store.read()
    now = int(time.time())
    usable = found.where(F.col("status") == "ok")
    supported = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(*registry.extensions())
    present = usable.where(supported).select("path", "content_hash", F.lit(now).cast("long").alias("last_indexed"))
    status = checkpointed(changes(old["files"], present))
    fresh = usable.join(status.where("status in ('new', 'changed')"), "path", "left_semi")
    parsed = checkpointed(parse_files(fresh, registry))
    parts = tables(parsed)
    new = refreshed(old, present, parts, registry.table(spark))
    version = store.commit(new)
    done = store.read()
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    indexed = n.get("new", 0) + n.get("changed", 0)
    return Indexed(
        version, indexed, found.count() - indexed, n.get("deleted", 0), done["symbols"].count(), done["raw_edges"].count(), done["edges"].count(), parts["errors"].count()
    )


def ensure_fresh(spark: SparkSession, store: Store, repo: Repo, registry: Registry) -> Indexed | None:
    """Index again if a file may have changed, judged by modification times, or has gone; None if nothing has."""
    paths = collect_files(repo.root, repo.include, repo.exclude)
    found = checkpointed(read_files(spark, repo.root, paths))
    files = store.read()["files"]
    supported = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(*registry.extensions())
    gone = files.join(found.select("path"), "path", "left_anti")
    if stale(files, found.where(supported & (F.col("status") == "ok")).select("path", "mtime")).isEmpty() and gone.isEmpty():
        return None
    return index_files(store, found, registry)
