"""Registered queries over a small tree of sources, from files to answers.

The tables of the driver hold no source code, so these queries bring a tree of their own. Their SQL gives the rows that
the rules call for, written out by hand.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config as conf
from loomgraph.errors import ConfigError, ParseError, RepoNotFound, StoreError
from loomgraph.model import EDGES, checked, metadata_value
from loomgraph.operators import crossrepo, maintain, nearest, resolve, retrieve, rollup, search, traverse
from loomgraph.operators.enrich import CodeOwners, enriched
from loomgraph.plans.index import ensure_fresh, index
from loomgraph.runtime import scratch_path
from loomgraph.sources.extract import parse_files, tables
from loomgraph.sources.files import as_sources, collect_files, read_files
from loomgraph.sources.languages import Registry, load_registry
from loomgraph.store import Store
from loomgraph.streaming.watch import watch

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_REGISTRY = Registry()

MODELS = """import os
from base.kit import Kit, Tool as T

class Model(Kit):
    def check(self):
        return self.size() > limit()

    def size(self):
        return 1

class Order(Model, extra.Mixin):
    async def total(cls):
        return cls.check()

def limit():
    return outer(inner(3))
"""
SERVICE = """from models import Order
from typing import *
from . import near
import json as j

def serve():
    from models import limit
    order = Order()
    return order.total(limit())

def outer(x):
    return x

serve()
"""
TREE = {"src/models.py": MODELS, "src/service.py": SERVICE, "docs/notes.txt": "nothing", "src/.hidden.py": "x = 1", "build/made.py": "def made(): pass\n", ".gitignore": "build/\n"}
#: A definition of each other language, and what it is.
SNIPPETS = (
    ("a.js", "class Dog extends Animal {\n  bark() { this.run(); }\n}\n"), ("a.ts", "interface Shape { area(): number }\n"), ("a.rs", "struct P { x: i32 }\nfn draw() { helper(1); }\n"),
    ("a.go", "func Run() {\n\tgo2()\n}\n"), ("A.java", "public class A extends B {\n  public void run() { list.add(1); plain(); }\n}\n"), ("a.c", "static int add(int a, int b) {\n  return twice(a) + b;\n}\n"),
    ("a.cpp", "class Box : public Base {\n  int size() { return width(); }\n};\n"), ("a.cs", "class A : Base {\n  void Run() { Go(); }\n}\n"), ("a.swift", "class A: B {\n  func run() { go() }\n}\n"),
    ("a.kt", "class A : B() {\n  fun run() { go() }\n}\n"), ("a.scala", "class A extends B {\n  def run() = { go() }\n}\n"), ("a.php", "<?php\nclass A extends B {\n  function run() { go(); }\n}\n"),
    ("a.rb", "class A < B\n  def run\n    go(1)\n  end\nend\n"), ("a.lua", "function run()\n  go()\nend\n"), ("a.zig", "pub fn run() void {\n  go();\n}\n"),
    ("a.hs", "data T = T Int\nrun x = x + 1\n"), ("a.ex", "defmodule A do\n  def run(x) do\n    go(x)\n  end\nend\n"), ("a.sh", "run() {\n  go one\n}\n"),
)


def query(name: str, columns: str, rows: list[tuple]) -> Callable[[Query], Query]:
    """Register a query whose rows are known; ``columns`` names them with their SQL types."""
    typed = [c.split(":") for c in columns.split()]

    def literal(value: object) -> str:
        if value is None or isinstance(value, bool):
            return {None: "null", True: "true", False: "false"}[value]
        return repr(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"

    casts = ", ".join(f'"{n}"::{t} as "{n}"' for n, t in typed)
    names = ", ".join(f'"{n}"' for n, _ in typed)
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)

    def register(function: Query) -> Query:
        _QUERIES[name] = function
        _SQL[name] = f"select {casts} from (values {listed}) as t({names})"
        return function

    return register


def _files(spark: SparkSession, files: dict[str, str | None]) -> DataFrame:
    return spark.createDataFrame(sorted(files.items()), "path string, text string")


def _parsed(spark: SparkSession, files: dict[str, str | None], **options: bool) -> dict[str, DataFrame]:
    return tables(parse_files(_files(spark, files), _REGISTRY, **options))


def _code(files: dict[str, str]) -> dict[str, str]:
    return {p: t for p, t in files.items() if p.startswith("src/") and "/." not in p}


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and raw edges of the tree."""
    parts = _parsed(spark, _code(TREE))
    symbols = resolve.last_of_each(parts["symbols"])
    return symbols, resolve.resolve(parts["raw_edges"], symbols, _REGISTRY.table(spark)), parts["raw_edges"]


def _named(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (source, target, kind) by names."""
    return retrieve.named_edges(edges, symbols).select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "kind")


# --- extraction -----------------------------------------------------------------------------------------------------

_SYMBOLS = [
    ("src/models.py", 0, "Model", "class", 4, 9), ("src/models.py", 1, "Order", "class", 11, 13), ("src/models.py", 2, "Model.check", "method", 5, 6), ("src/models.py", 3, "Model.size", "method", 8, 9),
    ("src/models.py", 4, "Order.total", "method", 12, 13), ("src/models.py", 5, "limit", "function", 15, 16), ("src/models.py", 6, "src/models.py", "module", 1, 1), ("src/models.py", 7, "os", "module", 1, 1), ("src/models.py", 8, "base.kit.Kit", "module", 2, 2),
    ("src/service.py", 0, "serve", "function", 6, 9), ("src/service.py", 1, "outer", "function", 11, 12), ("src/service.py", 2, "src/service.py", "module", 1, 1), ("src/service.py", 3, "models.Order", "module", 1, 1), ("src/service.py", 4, "models.limit", "module", 7, 7),
]
_RAW = [
    ("Model", "Kit", "inherits"), ("Order", "Model", "inherits"), ("Model.check", "Model.size", "calls"), ("Model.check", "limit", "calls"), ("Order.total", "Order.check", "calls"),
    ("limit", "outer", "calls"), ("limit", "inner", "calls"), ("src/models.py", "base.kit.Kit", "imports"),
    ("serve", "Order", "calls"), ("serve", "order.total", "calls"), ("serve", "limit", "calls"), ("src/service.py", "serve", "calls"), ("src/service.py", "models.Order", "imports"), ("serve", "models.limit", "imports"),
]
_EDGES = [
    ("Order", "Model", "inherits"), ("Model.check", "Model.size", "calls"), ("Model.check", "limit", "calls"), ("limit", "outer", "calls"), ("src/models.py", "base.kit.Kit", "imports"),
    ("serve", "Order", "calls"), ("serve", "limit", "calls"), ("src/service.py", "serve", "calls"), ("src/service.py", "models.Order", "imports"), ("serve", "models.limit", "imports"),
]


@query("extract_python_symbols", "file_path:varchar ord:int name:varchar kind:varchar line_start:int line_end:int", _SYMBOLS)
def _extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, _code(TREE))["symbols"].select("file_path", "ord", "name", "kind", "line_start", "line_end")


def _register_edges() -> None:
    for kind in ("inherits", "calls", "imports"):

        def run(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            parts = _parsed(spark, _code(TREE))
            names = parts["symbols"].select(F.col("id").alias("source"), F.col("name").alias("source_name"))
            return parts["raw_edges"].where(F.col("kind") == kind).join(names, "source").select("source_name", "target_name")

        query(f"extract_python_{kind}", "source_name:varchar target_name:varchar", [r[:2] for r in _RAW if r[2] == kind])(run)


_register_edges()


@query("extract_import_limits", "lenient:boolean name:varchar", [(False, "os"), (False, "p.q"), (True, "os"), (True, "a.b"), (True, "p.q"), (True, "p.r"), (True, "s.*"), (True, "..near")])
def _import_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases, stars and relative imports are left out, unless asked for."""
    files = {"m.py": "import os, a.b as c\nfrom p import q, r as t\nfrom s import *\nfrom . import near\n"}
    found = [_parsed(spark, files, lenient_imports=x)["symbols"].where("kind = 'module' and name <> 'm.py'").select(F.lit(x).alias("lenient"), "name") for x in (False, True)]
    return found[0].unionByName(found[1])


@query("extract_duplicate_ids", "name:varchar kind:varchar line_start:int", [("twice", "function", 4), ("K", "class", 7), ("K.m", "method", 8), ("d.py", "module", 1)])
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of symbols of one file, name and kind the last one stays."""
    files = {"d.py": "def twice():\n    return 1\n\ndef twice():\n    return 2\n\nclass K:\n    def m(self): pass\n"}
    return resolve.last_of_each(_parsed(spark, files)["symbols"]).select("name", "kind", "line_start")


@query("extract_errors", "path:varchar error:varchar symbols:bigint", [("bad.py", "SyntaxError", 2), ("good.py", None, 2), ("empty.py", None, 1)])
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that doesn't parse brings an error and what patterns find in it; others aren't affected; files of unknown
    extensions and unreadable ones bring nothing."""
    parts = _parsed(spark, {"bad.py": "def broken(:\n    pass\n", "good.py": "def f(): pass\n", "empty.py": "", "x.unknown": "def f(): pass\n", "none.py": None})
    counts = parts["symbols"].groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("symbols"))
    return counts.join(parts["errors"].withColumn("error", F.split("error", ":")[0]), "path", "left").select("path", "error", "symbols")


@query("extract_other_languages", "path:varchar name:varchar kind:varchar", [
    ("a.js", "Dog", "class"), ("a.js", "Dog.bark", "method"), ("a.ts", "Shape", "class"), ("a.rs", "P", "class"), ("a.rs", "draw", "function"), ("a.go", "Run", "function"), ("A.java", "A", "class"), ("A.java", "A.run", "method"),
    ("a.c", "add", "function"), ("a.cpp", "Box", "class"), ("a.cpp", "Box.size", "method"), ("a.cs", "A", "class"), ("a.cs", "A.Run", "method"), ("a.swift", "A", "class"), ("a.swift", "A.run", "method"), ("a.kt", "A", "class"), ("a.kt", "A.run", "method"),
    ("a.scala", "A", "class"), ("a.scala", "A.run", "method"), ("a.php", "A", "class"), ("a.php", "A.run", "method"), ("a.rb", "A", "class"), ("a.rb", "A.run", "method"), ("a.lua", "run", "function"), ("a.zig", "run", "function"),
    ("a.hs", "T", "class"), ("a.hs", "run", "function"), ("a.ex", "A", "class"), ("a.ex", "A.run", "method"), ("a.sh", "run", "function"),
])
def _other_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, dict(SNIPPETS))["symbols"].where("kind <> 'module'").select(F.col("file_path").alias("path"), "name", "kind")


@query("extract_other_languages_calls", "path:varchar source:varchar target:varchar", [
    ("a.js", "Dog.bark", "Dog.run"), ("a.rs", "draw", "helper"), ("a.go", "Run", "go2"), ("A.java", "A.run", "list.add"), ("a.c", "add", "twice"), ("a.cpp", "Box.size", "width"), ("a.cs", "A.Run", "Go"), ("a.swift", "A.run", "go"), ("a.kt", "A.run", "go"),
    ("a.scala", "A.run", "go"), ("a.php", "A.run", "go"), ("a.rb", "A.run", "go"), ("a.lua", "run", "go"), ("a.zig", "run", "go"), ("a.ex", "A.run", "go"), ("a.sh", "run", "go"),
])
def _other_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parsed(spark, dict(SNIPPETS))
    names = parts["symbols"].select(F.col("id").alias("source"), F.col("name").alias("n"))
    return parts["raw_edges"].where("kind = 'calls'").join(names, "source").select(F.col("file_path").alias("path"), F.col("n").alias("source"), F.col("target_name").alias("target"))


@query("extract_other_languages_inherits", "path:varchar source:varchar target:varchar", [
    ("a.js", "Dog", "Animal"), ("A.java", "A", "B"), ("a.cpp", "Box", "Base"), ("a.cs", "A", "Base"), ("a.swift", "A", "B"), ("a.kt", "A", "B"), ("a.scala", "A", "B"), ("a.php", "A", "B"), ("a.rb", "A", "B"),
])
def _other_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parsed(spark, dict(SNIPPETS))
    names = parts["symbols"].select(F.col("id").alias("source"), F.col("name").alias("n"))
    return parts["raw_edges"].where("kind = 'inherits'").join(names, "source").select(F.col("file_path").alias("path"), F.col("n").alias("source"), F.col("target_name").alias("target"))


_LANGUAGES = {
    "python": "py pyi", "javascript": "js jsx mjs", "typescript": "ts tsx", "rust": "rs", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hxx", "c_sharp": "cs", "swift": "swift", "kotlin": "kt kts", "scala": "scala sc",
    "php": "php", "ruby": "rb", "lua": "lua", "zig": "zig", "haskell": "hs", "elixir": "ex exs", "bash": "sh bash",
}


@query("language_table", "ext:varchar lang:varchar", [(e, lang) for lang, exts in _LANGUAGES.items() for e in exts.split()])
def _language_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _REGISTRY.table(spark)


@query("language_dispatch", "path:varchar lang:varchar", [("a.py", "python"), ("x/b.pyi", "python"), ("a.PY", None), ("Makefile", None), ("m.tsx", "typescript"), (".py", None)])
def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lang(path: str) -> str | None:
        try:
            return _REGISTRY.language(path).name
        except ParseError:
            return None

    return spark.createDataFrame([(p, lang(p)) for p in ("a.py", "x/b.pyi", "a.PY", "Makefile", "m.tsx", ".py")], "path string, lang string")


@query("language_folder", "name:varchar ext:varchar warnings:int", [("toy", "toy", 1)])
def _language_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages defined by files; one that doesn't read is a warning."""
    folder = _folder(spark, {"toy.toml": 'extensions = ["toy"]\nfunctions = ["^to (?P<name>\\\\w+)"]\nscope = "indent"\n', "bad.toml": "extensions = 3 ="})
    found, warnings = load_registry(folder, built_in=False)
    return spark.createDataFrame([(lang.name, e, len(warnings)) for lang in found.languages.values() for e in lang.extensions], "name string, ext string, warnings int")


# --- files and indexing ---------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, files: dict[str, str], at: int = 1_000_000) -> str:
    """A new folder in the shared one, if that is one of files, with ``files`` last changed at ``at``."""
    url = urlparse(scratch_path(spark, "tree"))
    if url.scheme not in ("", "file"):
        raise StoreError("the sample tree needs a shared folder in the file system")
    _write(url.path, files, at)
    return url.path


def _write(root: str, files: dict[str, str], at: int = 1_000_000) -> None:
    for name, text in files.items():
        path = Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (at, at))


def _store(spark: SparkSession, branch: str = "main") -> Store:
    return Store(spark, scratch_path(spark, "store"), "org", "demo", branch)


_ALL = conf.Repo("demo", "", [], [])


@query("collect_files", "path:varchar", [("docs/notes.txt",), ("src/models.py",), ("src/service.py",)])
def _collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in collect_files(_folder(spark, TREE))], "path string")


@query("collect_files_globs", "path:varchar", [("build/made.py",), ("src/models.py",)])
def _collect_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matches is taken, even if ignored; what is excluded never is."""
    return spark.createDataFrame([(p,) for p in collect_files(_folder(spark, TREE), ["**/*.py"], ["**/service.py"])], "path string")


@query("read_whole_files", "path:varchar size:int mtime:bigint status:varchar", [("docs/notes.txt", 7, 1_000_000, "ok"), ("src/models.py", len(MODELS), 1_000_000, "ok"), ("odd.py", None, 5, "unreadable")])
def _read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, TREE)
    Path(root, "odd.py").write_bytes(b"\xff\xfe\x00")
    os.utime(Path(root, "odd.py"), (5, 5))
    found = read_files(spark, root, ["docs/notes.txt", "src/models.py", "odd.py"])
    return found.select("path", F.octet_length("text").alias("size"), "mtime", "status")


@query("git_branch", "branch:varchar", [("feature/x",)])
def _branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, {"a.py": "x = 1"})
    for step in (["init", "-q", "-b", "feature/x"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@x.org", "commit", "-qm", "one"]):
        subprocess.run(["git", "-C", root, *step], check=True, capture_output=True)
    return spark.createDataFrame([(conf.current_branch(root),)], "branch string")


_COUNTS = "step:varchar version:int files:int skipped:int deleted:int symbols:int raw_edges:int edges:int errors:int"


@query("index_incremental", _COUNTS, [
    ("first", 1, 2, 1, 0, 14, 14, 10, 0), ("nothing changed", 2, 0, 3, 0, 14, 14, 10, 0), ("one changed, one new", 3, 2, 2, 0, 17, 14, 11, 0), ("one gone", 4, 0, 3, 1, 12, 8, 5, 0), ("forced", 1, 2, 1, 0, 12, 8, 5, 0),
])
def _index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of successive runs: files that content hashes call unchanged are skipped."""
    root = _folder(spark, TREE)
    store, repo = _store(spark), replace(_ALL, root=root)
    done = [("first", index(spark, store, repo, _REGISTRY)), ("nothing changed", index(spark, store, repo, _REGISTRY))]
    _write(root, {"src/models.py": MODELS + "\ndef inner(x): pass\n", "src/new.py": "def fresh(): pass\n"})
    done.append(("one changed, one new", index(spark, store, repo, _REGISTRY)))
    Path(root, "src/service.py").unlink()
    done.append(("one gone", index(spark, store, repo, _REGISTRY)))
    done.append(("forced", index(spark, store, repo, _REGISTRY, force=True)))
    rows = [(step, d.version, d.files, d.skipped, d.deleted, d.symbols, d.raw_edges, d.edges, d.errors) for step, d in done]
    return spark.createDataFrame(rows, "step string, version int, files int, skipped int, deleted int, symbols int, raw_edges int, edges int, errors int")


@query("incremental_equals_rebuild", "part:varchar only_incremental:bigint only_rebuilt:bigint", [("symbols", 0, 0), ("edges", 0, 0), ("raw_edges", 0, 0)])
def _rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are resolved over the whole graph: a store that was kept up to date equals one built anew."""
    root = _folder(spark, {**TREE, "src/models.py": "def limit(): pass\n"})
    repo = replace(_ALL, root=root)
    kept, anew = _store(spark), _store(spark, "rebuilt")
    index(spark, kept, repo, _REGISTRY)
    _write(root, TREE)
    index(spark, kept, repo, _REGISTRY)
    index(spark, anew, repo, _REGISTRY, force=True)
    a, b = kept.read(), anew.read()
    counts = [(p, a[p].exceptAll(b[p]).count(), b[p].exceptAll(a[p]).count()) for p in ("symbols", "edges", "raw_edges")]
    return spark.createDataFrame(counts, "part string, only_incremental long, only_rebuilt long")


@query("refresh_when_stale", "step:varchar indexed:boolean", [("unchanged", False), ("touched", True), ("deleted", True), ("settled", False)])
def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, TREE)
    store, repo = _store(spark), replace(_ALL, root=root)
    index(spark, store, repo, _REGISTRY)
    rows = [("unchanged", ensure_fresh(spark, store, repo, _REGISTRY) is not None)]
    _write(root, {"src/models.py": MODELS}, at=4_000_000_000)
    rows.append(("touched", ensure_fresh(spark, store, repo, _REGISTRY) is not None))
    _write(root, {"src/models.py": MODELS})
    Path(root, "src/service.py").unlink()
    rows.append(("deleted", ensure_fresh(spark, store, repo, _REGISTRY) is not None))
    rows.append(("settled", ensure_fresh(spark, store, repo, _REGISTRY) is not None))
    return spark.createDataFrame(rows, "step string, indexed boolean")


@query("stale_by_mtime", "path:varchar", [("b",), ("c",), ("new",)])
def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("a", "h", 10), ("b", "h", 10), ("c", "h", 10)], "path string, content_hash string, last_indexed long")
    return maintain.stale(files, spark.createDataFrame([("a", 9), ("b", 10), ("c", 11), ("new", 1)], "path string, mtime long"))


@query("store_scan", "part:varchar n:bigint", [("symbols", 14), ("edges", 10), ("raw_edges", 14), ("files", 2), ("annotations", 0)])
def _store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    index(spark, store, replace(_ALL, root=_folder(spark, TREE)), _REGISTRY)
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p, t in store.labelled().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("store_versions", "step:varchar version:int n:bigint", [("none", 0, 0), ("first", 1, 1), ("second", 2, 2), ("failed", 2, 2), ("rolled back", 1, 1)])
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit is seen whole or not at all."""
    store = _store(spark)
    rows = []

    def seen(step: str) -> None:
        rows.append((step, store.version(), store.read()["edges"].count()))

    def edges(*names: str) -> DataFrame:
        return spark.createDataFrame([(n, "t", "calls") for n in names], EDGES)

    seen("none")
    store.commit({"edges": edges("a")})
    seen("first")
    store.commit({"edges": edges("a", "b")})
    seen("second")
    try:
        store.commit({"edges": edges("a", "b", "c").withColumn("kind", F.raise_error(F.lit("no")).cast("string"))})
    except Exception:  # noqa: BLE001  the commit is meant to fail
        seen("failed")
    store.rollback()
    seen("rolled back")
    return spark.createDataFrame(rows, "step string, version int, n long")


@query("watched_files", "step:varchar name:varchar", [("first", "one"), ("second", "one"), ("second", "two")])
def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files keeps a store up to date."""
    root = _folder(spark, {"a.py": "def one(): pass\n"}, at=2_000_000)
    store, checkpoint = _store(spark), scratch_path(spark, "watched")
    found = []
    for step, files in (("first", {}), ("second", {"b.py": "def two(): one()\n"})):
        _write(root, files, at=3_000_000)
        run = watch(spark, store, Path(root).as_uri(), _REGISTRY, checkpoint, debounce=None)
        run.awaitTermination()
        if run.exception() is not None:
            raise StoreError(str(run.exception()))
        found.append(spark.createDataFrame([(step, r.name) for r in store.read()["symbols"].where("kind = 'function'").collect()], "step string, name string"))
    return found[0].unionByName(found[1])


# --- answers --------------------------------------------------------------------------------------------------------


@query("tree_edges_resolved", "source:varchar target:varchar kind:varchar", _EDGES)
def _tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    return _named(edges, symbols)


@query("edges_without_ends", "source:varchar target:varchar kind:varchar", [("serve", "?", "calls")])
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    gone = symbols.where("name <> 'outer'")
    return _named(maintain.orphans(gone.where("name <> 'Order'"), edges), gone.where("name <> 'Order'")).where("source = 'serve'")


_LIMIT_CONTEXT = [("Model.check", 1, "\n".join(MODELS.split("\n")[3:7])), ("outer", 1, "\n".join(SERVICE.split("\n")[9:13])), ("serve", 1, "\n".join(SERVICE.split("\n")[4:10]))]


@query("context_snippets", "name:varchar depth:int snippet:varchar", _LIMIT_CONTEXT)
def _context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    return retrieve.context(symbols, edges, _files(spark, _code(TREE)), "limit", depth=1, context_lines=1).neighbors.select("name", "depth", "snippet")


@query("context_defaults", "name:varchar depth:int", [("Model.check", 1), ("outer", 1), ("serve", 1), ("Model.size", 2), ("Order", 2), ("models.limit", 2), ("src/service.py", 2), ("limit", 2)])
def _context_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps either way, no limit; both ways lead back to the root."""
    symbols, edges, _ = _graph(spark)
    return retrieve.context(symbols, edges, None, "limit").neighbors.select("name", "depth")


@query("context_json", "json:varchar", [('{"root":{"name":"Order","kind":"class","file":"src/models.py","lines":[11,13],"snippet":"class Order(Model, extra.Mixin):\\n    async def total(cls):\\n        return cls.check()"},"near":["Model","serve"],"edges":2}',)])
def _context_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    whole = retrieve.context(symbols, edges, _files(spark, _code(TREE)), "Order", depth=1, context_lines=0).as_json()
    root = "root struct<name string, kind string, file string, lines array<int>, snippet string>, neighbors array<struct<name string>>, edges array<struct<source string>>"
    read = F.from_json("json", root)
    return whole.select(F.to_json(F.struct(read["root"].alias("root"), read["neighbors"]["name"].alias("near"), F.size(read["edges"]).alias("edges"))).alias("json"))


@query("context_missing", "found:boolean", [(False,)])
def _context_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    return spark.createDataFrame([(retrieve.context(symbols, edges, None, "nowhere") is not None,)], "found boolean")


@query("search_one_repo", "repo:varchar name:varchar rank:int", [("b", "limit", 1), ("b", "models.limit", 2)])
def _one_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, _, _ = _graph(spark)
    both = symbols.withColumn("repo", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return search.search_repos(both, "limit", repo="b").select("repo", "name", "rank")


@query("graph_json", "view:varchar part:varchar json:varchar", [
    ("symbols", "nodes", '{"name":"serve","kind":"function","file":"src/service.py","line":6,"lang":"py"}'), ("symbols", "nodes", '{"name":"outer","kind":"function","file":"src/service.py","line":11,"lang":"py"}'),
    ("files", "nodes", '{"id":"src/service.py","name":"service.py","lang":"py","symbols":5}'), ("files", "nodes", '{"id":"src/models.py","name":"models.py","lang":"py","symbols":9}'),
    ("files", "links", '{"source":"src/models.py","target":"src/service.py","kind":"calls","weight":1}'), ("files", "links", '{"source":"src/service.py","target":"src/models.py","kind":"calls","weight":2}'),
])
def _graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file view, and the functions of one file from the symbol view."""
    symbols, edges, _ = _graph(spark)
    found = rollup.graph_json(symbols, edges)
    plain = F.regexp_replace("json", r'"id":"[0-9a-f]{32}",', "")
    functions = F.col("json").contains('"kind":"function","file":"src/service.py"')
    return found.where((F.col("view") == "files") | functions).select("view", "part", plain.alias("json"))


@query("graph_json_links", "n:bigint known:bigint", [(10, 10)])
def _graph_json_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    links = rollup.graph_json(symbols, edges).where("view = 'symbols' and part = 'links'")
    return links.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.get_json_object("json", "$.kind").isin("calls", "imports", "inherits"), 1)).alias("known"))


@query("strict_kinds_and_metadata", "id:varchar kind:varchar route:varchar", [("1", "function", "/x"), ("2", "class", None)])
def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1", "function", '{"route": "/x"}'), ("2", "class", None)]
    return checked(spark.createDataFrame(rows, "id string, kind string, metadata string")).select("id", "kind", metadata_value("$.route").alias("route"))


@query("strict_errors", "case:varchar refused:boolean", [("kind", True), ("metadata", True), ("sound", False)])
def _strict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refused(kind: str, metadata: str | None) -> bool:
        try:
            checked(spark.createDataFrame([("1", kind, metadata)], "id string, kind string, metadata string")).collect()
        except Exception:  # noqa: BLE001  that it is refused is what is asked
            return True
        return False

    rows = [("kind", refused("widget", None)), ("metadata", refused("class", "{")), ("sound", refused("class", "{}"))]
    return spark.createDataFrame(rows, "`case` string, refused boolean")


@query("file_records_upsert", "path:varchar content_hash:varchar last_indexed:bigint", [("a", "1", 5), ("b", "9", 8), ("c", "3", 8)])
def _file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "path string, content_hash string, last_indexed long"
    return maintain.upsert_files(spark.createDataFrame([("a", "1", 5), ("b", "2", 5)], schema), spark.createDataFrame([("b", "9", 8), ("c", "3", 8)], schema))


# --- across repositories --------------------------------------------------------------------------------------------

_REFERENCES = "source_repo string, source_branch string, source_symbol string, target_package string, target_path string, kind string"
_OFFERED = "repo string, branch string, id string, name string, file_path string"


def _across(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross edges and unresolved references after the second repository was indexed, and its symbols."""
    asked = [("app", "main", "s", "lib", "lib.util.run", "imports"), ("app", "main", "t", "lib", "lib.gone", "imports"), ("web", "dev", "u", "other", "other.x", "imports")]
    deps = spark.createDataFrame([("lib", "lib-repo")], "package string, repo string")
    waiting = crossrepo.answers(spark.createDataFrame(asked, _REFERENCES), deps, spark.createDataFrame([], _OFFERED))
    offered = spark.createDataFrame([("lib-repo", "main", "9", "run", "src/lib/util.py"), ("lib-repo", "main", "8", "run", "src/else.py")], _OFFERED)
    return (*crossrepo.reconciled(*waiting, deps, offered), offered)


_CROSS = "source_repo:varchar source_symbol:varchar target_repo:varchar target_symbol:varchar"


@query("cross_repo_reconciled", _CROSS, [("app", "s", "lib-repo", "9")])
def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _across(spark)[0].select("source_repo", "source_symbol", "target_repo", "target_symbol")


@query("cross_repo_waiting", "target_package:varchar source_symbol:varchar", [("lib", "t")])
def _waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrepo.waiting_for(_across(spark)[1], "lib").select("target_package", "source_symbol")


@query("cross_repo_invalidated", "alive:boolean source_symbol:varchar", [(False, "s")])
def _invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, offered = _across(spark)
    alive, dead = crossrepo.invalidated(edges, offered.where("id <> '9'"))
    return alive.select(F.lit(True).alias("alive"), "source_symbol").unionByName(dead.select(F.lit(False).alias("alive"), "source_symbol"))


@query("cross_repo_store", "read:varchar n:bigint", [("of source", 1), ("of target", 1), ("to symbols", 1), ("without repo", 0), ("of another", 0)])
def _cross_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, offered = _across(spark)
    reads = [
        ("of source", crossrepo.of_source(edges, "app", "main")), ("of target", crossrepo.of_target(edges, "lib-repo", "main")), ("to symbols", crossrepo.to_symbols(edges, offered)),
        ("without repo", crossrepo.without_repo(edges, "app", "main")), ("of another", crossrepo.of_source(edges, "web", "dev")),
    ]
    return spark.createDataFrame([(name, frame.count()) for name, frame in reads], "read string, n long")


@query("semantic_context", "id:varchar depth:int seed:boolean", [("serve", 0, True), ("outer", 0, True), ("Order", 1, False), ("limit", 1, False), ("src/service.py", 1, False), ("models.limit", 1, False)])
def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols whose vectors are nearest, and what surrounds them."""
    symbols, edges, _ = _graph(spark)
    ids = {r["name"]: r["id"] for r in symbols.collect()}
    vectors = spark.createDataFrame([(ids["serve"], [1.0, 0.1]), (ids["outer"], [1.0, 0.0]), (ids["Model"], [0.0, 1.0])], "id string, embedding array<float>")
    return nearest.semantic_context(symbols, edges, vectors, [1.0, 0.0], k=2, depth=1).select(F.col("name").alias("id"), "depth", F.col("similarity").isNotNull().alias("seed"))


# --- configuration and annotations ----------------------------------------------------------------------------------

_CONFIG = '[organization]\nname = "org"\n[[repos]]\nname = "one"\nroot = "/tmp/one"\ninclude = ["src/**/*.py"]\n[[deps]]\npackage = "lib"\nrepo = "one"\n[[deps]]\npackage = "lost"\nrepo = "gone"\n'


@query("configuration", "key:varchar value:varchar", [
    ("organization", "org"), ("port", "3100"), ("max_hop_depth", "4"), ("repo of /tmp/one/x", "one"), ("repo of /tmp", "none"), ("picked", "one"), ("broken deps", "lost"), ("again", "True"), ("unknown key", "refused"), ("ttl of 30d", "2592000"),
])
def _configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conf.parse(_CONFIG)

    def owner(folder: str) -> str:
        try:
            return c.repo_of(folder).name
        except RepoNotFound:
            return "none"

    try:
        conf.parse(_CONFIG + "[server]\nnope = 1\n")
        unknown = "taken"
    except ConfigError:
        unknown = "refused"
    rows = [
        ("organization", c.organization.name), ("port", str(c.server.port)), ("max_hop_depth", str(c.graph.max_hop_depth)), ("repo of /tmp/one/x", owner("/tmp/one/x")), ("repo of /tmp", owner("/tmp")), ("picked", c.pick("one").name),
        ("broken deps", ",".join(d.package for d in conf.broken_deps(c))), ("again", str(conf.parse(conf.dump(c)) == c)), ("unknown key", unknown), ("ttl of 30d", str(conf.seconds("30d"))),
    ]
    return spark.createDataFrame(rows, "key string, value string")


@query("configuration_changes", "step:varchar value:varchar", [("init", "org"), ("init again", "refused"), ("add", "**/*.py,**/*.ts"), ("add outside git", "refused"), ("deps", "p")])
def _configuration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, {"repo/.git/HEAD": "ref: refs/heads/main\n", "plain/x": ""})
    made = conf.init("org", f"{root}/config.toml")

    def refused(step: Callable[[], object]) -> str:
        try:
            step()
        except ConfigError:
            return "refused"
        return "taken"

    c = conf.load(str(made))
    rows = [("init", c.organization.name), ("init again", refused(lambda: conf.init("org", str(made)))), ("add", ",".join(conf.add_repo(c, f"{root}/repo", extensions=["ts", "py"]).include))]
    rows.append(("add outside git", refused(lambda: conf.add_repo(c, f"{root}/plain"))))
    conf.add_dep(c, "p", "repo")
    conf.add_dep(c, "q", "repo")
    conf.remove_dep(c, "q")
    rows.append(("deps", ",".join(d.package for d in c.deps)))
    return spark.createDataFrame(rows, "step string, value string")


@query("code_owners", "name:varchar value:varchar", [("serve", "@core @ops"), ("outer", "@core @ops"), ("limit", "@all"), ("Model", "@all"), ("Order", "@all")])
def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rule that matches a file owns its symbols; a second run replaces what the first has said."""
    symbols, _, _ = _graph(spark)
    chosen = symbols.where("kind in ('function', 'class')")
    none = spark.createDataFrame([], "symbol_id string, source string, key string, value string")
    rules = CodeOwners(["# owners", "* @all", "/src/service.py @core @ops"])
    found = enriched(enriched(none, chosen, CodeOwners(["* @nobody"])), chosen, rules)
    return found.join(chosen.select(F.col("id").alias("symbol_id"), "name"), "symbol_id").select("name", "value")


@query("sources_for_snippets", "path:varchar lines:int", [("docs/notes.txt", 1), ("src/service.py", 15)])
def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = as_sources(read_files(spark, _folder(spark, TREE), ["docs/notes.txt", "src/service.py"]))
    return found.select("path", F.size(F.split("text", "\n")).alias("lines"))


@query("traversal_by_kinds", "name:varchar depth:int", [("limit", 1), ("Order", 1), ("outer", 2)])
def _by_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges, _ = _graph(spark)
    root = symbols.where("name = 'serve'").first()["id"]
    return traverse.neighbors(symbols, edges, root, "outgoing", 2, kinds=["calls"]).select("name", "depth")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
