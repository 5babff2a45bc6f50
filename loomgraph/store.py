"""Versioned snapshots of a graph as Parquet.

A store holds one folder for each repository and branch. Every commit writes all tables to a new version's folder and
then replaces a small pointer, so readers see a whole version or the one before, and a failed commit leaves no trace
that anyone reads. Tables are laid out for the queries: symbols by file and name, edges by source; each file of a table
holds a range of its own, so that a read by these columns skips the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import StoreError
from loomgraph.functions.text import branch_folder
from loomgraph.model import ANNOTATIONS, EDGES, FILES, RAW_EDGES, SYMBOLS
from loomgraph.operators import maintain
from loomgraph.operators.resolve import last_of_each, resolve

TABLES: dict[str, T.StructType] = {
    "symbols": T.StructType([*SYMBOLS.fields, T.StructField("ord", T.IntegerType(), True)]),
    "edges": EDGES,
    "raw_edges": RAW_EDGES,
    "files": FILES,
    "annotations": ANNOTATIONS,
}
#: By which columns rows of a table are dealt into ranges and sorted, for the statistics of files and row groups.
LAYOUT = {"symbols": ["file_path", "name"], "edges": ["source"], "raw_edges": ["file_path"], "files": ["path"], "annotations": ["symbol_id"]}
#: Versions that are kept besides the current one.
KEPT = 1


class Store:
    """The snapshots of one repository's branch below ``root``, a folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, org: str, repo: str, branch: str):
        self.spark, self.repo, self.branch = spark, repo, branch
        self.folder = f"{root.rstrip('/')}/{org}/{repo}/{branch_folder(branch)}"

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, 0 if nothing has been committed."""
        fs, pointer = self._fs(), self._path("_CURRENT")
        if not fs.exists(pointer):
            return 0
        reader = fs.open(pointer)
        try:
            return int(bytes(reader.readAllBytes()).decode())
        finally:
            reader.close()

    def read(self) -> dict[str, DataFrame]:
        """All tables of the current version; empty ones if there is none."""
        now = self.version()
        if not now:
            return {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.folder}/v={now}/{name}") for name, schema in TABLES.items()}

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write a new version and make it current. Missing tables are taken over from the current one."""
        now = self.version()
        old = self.read()
        new = now + 1
        fs = self._fs()
        fs.delete(self._path(f"v={new}"), True)  # what a failed commit may have left
        for name, schema in TABLES.items():
            frame = tables.get(name, old[name])
            frame = frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
            frame.repartitionByRange(*LAYOUT[name]).sortWithinPartitions(*LAYOUT[name]).write.mode("overwrite").parquet(f"{self.folder}/v={new}/{name}")
        self._point(new)
        for stale in range(1, new - KEPT):
            fs.delete(self._path(f"v={stale}"), True)
        return new

    def _point(self, version: int) -> None:
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        out = fs.create(self._path("_CURRENT.next"), True)
        out.write(bytearray(str(version).encode()))
        out.close()
        # a rename that replaces is one step in the file systems that have it
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path("_CURRENT.next"), self._path("_CURRENT"), options)

    def rollback(self) -> int:
        """Make the version before the current one current again."""
        now = self.version()
        if now < 2 or not self._fs().exists(self._path(f"v={now - 1}")):
            raise StoreError("there is no earlier version")
        self._point(now - 1)
        return now - 1

    def drop(self) -> None:
        """Delete all versions."""
        self._fs().delete(self._path(), True)

    def labelled(self) -> dict[str, DataFrame]:
        """All tables with columns ``repo`` and ``branch``."""
        return {n: t.withColumns({"repo": F.lit(self.repo), "branch": F.lit(self.branch)}) for n, t in self.read().items()}


def refreshed(old: dict[str, DataFrame], found: DataFrame, parsed: dict[str, DataFrame], extensions: DataFrame) -> dict[str, DataFrame]:
    """New tables from old ones and the files that are there now.

    ``found`` has (path, content_hash, last_indexed) of every file; ``parsed`` has symbols and raw_edges of those that
    are new or changed. Files that are gone or changed lose everything they had; then all raw edges are resolved
    anew, so the result is that of a rebuild from nothing.
    """
    status = maintain.changes(old["files"], found)
    kept = maintain.delete_files(old, status.where("status in ('changed', 'deleted')").select("path"))
    symbols = last_of_each(kept["symbols"].unionByName(parsed["symbols"], allowMissingColumns=True))
    raw = kept["raw_edges"].unionByName(parsed["raw_edges"])
    new_files = found.join(status.where("status in ('new', 'changed')"), "path").select("path", "content_hash", "last_indexed")
    edges = resolve(raw, symbols, extensions)
    return {
        "symbols": symbols,
        "raw_edges": raw,
        "edges": edges,
        "files": maintain.upsert_files(kept["files"], new_files),
        "annotations": kept["annotations"].join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"),
    }


def prune(spark: SparkSession, root: str, org: str, older_than: int, now: int) -> list[str]:
    """Delete branches whose pointers haven't changed for ``older_than`` seconds, and return their folders."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{org}/*/*/_CURRENT")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for found in fs.globStatus(base) or []:
        if found.getModificationTime() // 1000 < now - older_than:
            folder = found.getPath().getParent()
            fs.delete(folder, True)
            gone.append(folder.toString())
    return gone
