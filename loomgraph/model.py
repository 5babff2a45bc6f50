"""The data model: a directed multi-kind graph of symbols, kept in flat tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of symbols and of edges.
SYMBOL_KINDS = ("function", "class", "method", "module", "variable", "type")
EDGE_KINDS = ("calls", "imports", "inherits", "references", "typeof")


class Direction(Enum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    BOTH = "both"


class Retrieval(Enum):
    STRUCTURAL = "structural"
    SEMANTIC = "semantic"
    COMBINED = "combined"


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

SYMBOLS = _table(("id", _S, False), ("name", _S, False), ("kind", _S, False), ("file_path", _S, False), ("line_start", _I, True), ("line_end", _I, True), ("metadata", _S, True))
EDGES = _table(("source", _S, False), ("target", _S, False), ("kind", _S, False))
FILES = _table(("path", _S, False), ("content_hash", _S, False), ("last_indexed", _L, False))
ANNOTATIONS = _table(("symbol_id", _S, False), ("source", _S, False), ("key", _S, False), ("value", _S, True))
#: Edges whose targets are still names. They are kept, so that resolution can always see the whole graph.
RAW_EDGES = _table(("source", _S, False), ("target_name", _S, False), ("kind", _S, False), ("file_path", _S, False), ("ord", _I, False))
EXTENSIONS = _table(("ext", _S, False), ("lang", _S, False))
CROSS_EDGES = _table(*((f"{end}_{part}", _S, False) for end in ("source", "target") for part in ("repo", "branch", "symbol")), ("kind", _S, False))
UNRESOLVED = _table(
    ("id", _S, False), ("source_repo", _S, False), ("source_branch", _S, False), ("source_symbol", _S, False),
    ("target_package", _S, False), ("target_path", _S, False), ("kind", _S, False), ("created_at", _L, False),
)
EMBEDDINGS = _table(("id", _S, False), ("embedding", T.ArrayType(T.FloatType()), False))

SYMBOL_COLUMNS = [f.name for f in SYMBOLS.fields]


def symbol_id(file_path: Column, name: Column, kind: Column) -> Column:
    """The id of a symbol: a digest of its file, name and kind, the same wherever the tree is checked out."""
    return F.md5(F.concat_ws("\0", file_path, name, kind))


def extension(path: Column) -> Column:
    """The last extension of a path's file name, case kept; null without one."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def checked(symbols: DataFrame) -> DataFrame:
    """Symbols whose kinds and metadata are read strictly: an unknown kind or malformed JSON raises an error."""
    kind = F.when(F.col("kind").isin(*SYMBOL_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown symbol kind: "), F.col("kind"))))
    out = symbols.withColumn("kind", kind)
    if "metadata" in symbols.columns:
        parsed = F.when(F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
        out = out.withColumn("metadata", parsed.otherwise(F.raise_error(F.concat(F.lit("metadata is not JSON: "), F.col("metadata")))))
    return out


def metadata_value(path: str, kind: str = "string") -> Column:
    """One value of the metadata column, by JSON path; null where the metadata is null or malformed."""
    return F.try_variant_get(F.try_parse_json("metadata"), path, kind)


@dataclass(frozen=True)
class SubGraph:
    """Nodes with their depths, and the edges among them."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Context:
    """A symbol, what surrounds it, and the edges among all of them."""

    root: DataFrame
    neighbors: DataFrame
    edges: DataFrame
    method: Retrieval = Retrieval.STRUCTURAL

    def as_json(self) -> DataFrame:
        """One row (json): the root, its neighbours by depth, and edges."""
        entry = F.struct("name", "kind", F.col("file_path").alias("file"), F.array("line_start", "line_end").alias("lines"), "snippet")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("depth", "name", "id", entry.alias("entry")))), lambda x: x["entry"])
        near = self.neighbors.agg(ordered.alias("neighbors"))
        links = self.edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
        # each side is one row
        whole = self.root.limit(1).select(entry.alias("root")).join(near).join(links)
        return whole.select(F.to_json(F.struct("root", "neighbors", "edges")).alias("json"))
