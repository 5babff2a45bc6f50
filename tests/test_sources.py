"""Parsing, indexing, snapshots, configuration, enrichment and the stream of files."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph import config as conf
from loomgraph.errors import ConfigError, ParseError, RepoNotFound
from loomgraph.operators import crossrepo, maintain, search, traverse
from loomgraph.operators.enrich import CodeOwners, GitBlame, enriched
from loomgraph.operators.retrieve import dependents
from loomgraph.plans.index import ensure_fresh, index, index_files
from loomgraph.sources.extract import extract, parse_files, register_udtf, tables
from loomgraph.sources.files import collect_files, read_files
from loomgraph.sources.languages import BUILT_IN, Registry, load_registry
from loomgraph.store import Store, prune
from loomgraph.streaming.watch import watch

REGISTRY = Registry()


def read(path, text, **options):
    symbols, edges, error = extract(path, text, REGISTRY.language(path), **options)
    return {(n, k): (a, b) for _, n, k, a, b in symbols}, {(s, t, k) for s, t, k in edges}, error, {i: n for i, n, *_ in symbols}


def named(path, text, **options):
    symbols, edges, _, names = read(path, text, **options)
    return symbols, {(names[s], t, k) for s, t, k in edges}


def test_python_definitions():
    symbols, edges = named("m.py", "def foo(x):\n    y = x\n    return y\n\nclass A(Base, mod.Other):\n    def run(self):\n        self.step()\n        helper(inner())\n    async def go(cls): cls.run()\n")
    assert symbols[("foo", "function")] == (1, 3) and symbols[("A", "class")] == (5, 9) and symbols[("A.run", "method")] == (6, 8)
    assert ("m.py", "module") in symbols
    assert edges == {("A", "Base", "inherits"), ("A.run", "A.step", "calls"), ("A.run", "helper", "calls"), ("A.run", "inner", "calls"), ("A.go", "A.run", "calls")}


def test_python_imports():
    text = "import os, a.b as c\nfrom os.path import join, split as s\nfrom . import rel\nfrom typing import *\ndef f():\n    from x import y\n"
    symbols, edges = named("m.py", text)
    assert {n for n, k in symbols if k == "module"} == {"m.py", "os", "os.path.join", "x.y"}
    assert edges == {("m.py", "os.path.join", "imports"), ("f", "x.y", "imports")}
    lenient, _ = named("m.py", text, lenient_imports=True)
    assert ("os.path.split", "module") in lenient and (".rel" in "".join(n for n, _ in lenient))


def test_python_that_does_not_parse_is_read_by_patterns():
    symbols, _, error, _ = read("m.py", "def foo(:\n    bar()\n\nclass B:\n    def m(self): pass\n")
    assert "SyntaxError" in error and ("foo", "function") in symbols and ("B.m", "method") in symbols


SNIPPETS = {
    "javascript": ("a.js", "import x from 'lib';\nclass Dog extends Animal {\n  bark() { this.run(); log('if (x) {'); }\n}\nfunction top() { return bark2(); }\n", {("Dog", "class"), ("Dog.bark", "method"), ("top", "function"), ("'lib'", "module")}, {("Dog", "Animal", "inherits"), ("Dog.bark", "Dog.run", "calls"), ("top", "bark2", "calls")}),
    "typescript": ("a.ts", "interface Shape { area(): number }\nconst go = (a: number) => { walk(a); };\n", {("Shape", "class")}, set()),
    "rust": ("a.rs", "use std::fmt;\nstruct P { x: i32 }\nimpl Draw for P {\n    fn draw(&self) { helper(self.x); }\n}\n", {("P", "class"), ("P.draw", "method"), ("std::fmt", "module")}, {("P.draw", "helper", "calls"), ("P", "Draw", "inherits")}),
    "go": ("a.go", "import \"fmt\"\ntype T struct { a int }\nfunc (t *T) Run() {\n\tfmt.Println(t.a)\n}\n", {("T", "class"), ("Run", "function"), ('"fmt"', "module")}, {("Run", "fmt.Println", "calls")}),
    "java": ("A.java", "import java.util.List;\npublic class A extends B {\n  public void run() { list.add(1); plain(); }\n}\n", {("A", "class"), ("A.run", "method"), ("java.util.List", "module")}, {("A", "B", "inherits"), ("A.run", "list.add", "calls")}),
    "c": ("a.c", "#include <stdio.h>\nstatic int add(int a, int b) {\n  return twice(a) + b; /* call(x) */\n}\n", {("add", "function"), ("<stdio.h>", "module")}, {("add", "twice", "calls")}),
    "cpp": ("a.cpp", "class Box : public Base {\n  int size() { return width(); }\n};\n", {("Box", "class"), ("Box.size", "method")}, {("Box.size", "width", "calls"), ("Box", "Base", "inherits")}),
    "c_sharp": ("a.cs", "using System;\nclass A : Base {\n  void Run() { obj.Go(); }\n}\n", {("A", "class"), ("A.Run", "method"), ("System", "module")}, {("A.Run", "obj.Go", "calls"), ("A", "Base", "inherits")}),
    "swift": ("a.swift", "import Foundation\nclass A: B {\n  func run() { go() }\n}\n", {("A", "class"), ("A.run", "method"), ("Foundation", "module")}, {("A.run", "go", "calls"), ("A", "B", "inherits")}),
    "kotlin": ("a.kt", "import a.b\nclass A : B() {\n  fun run() { go() }\n}\n", {("A", "class"), ("A.run", "method"), ("a.b", "module")}, {("A.run", "go", "calls"), ("A", "B", "inherits")}),
    "scala": ("a.scala", "import a.b\nclass A extends B {\n  def run() = { go() }\n}\n", {("A", "class"), ("A.run", "method"), ("a.b", "module")}, {("A.run", "go", "calls"), ("A", "B", "inherits")}),
    "php": ("a.php", "<?php\nuse App\\Model;\nclass A extends B {\n  function run() { go(); }\n}\n", {("A", "class"), ("A.run", "method"), ("App\\Model", "module")}, {("A.run", "go", "calls"), ("A", "B", "inherits")}),
    "ruby": ("a.rb", "require 'set'\nclass A < B\n  def run\n    go(1)\n  end\nend\ndef later\nend\n", {("A", "class"), ("A.run", "method"), ("later", "function"), ("'set'", "module")}, {("A.run", "go", "calls"), ("A", "B", "inherits")}),
    "lua": ("a.lua", "local x = require('lib')\nfunction run()\n  if a then go() end\nend\nfunction two() end\n", {("run", "function"), ("two", "function"), ("'lib'", "module")}, {("run", "go", "calls")}),
    "zig": ("a.zig", "const std = @import(\"std\");\npub fn run() void {\n  go();\n}\n", {("run", "function"), ('"std"', "module")}, {("run", "go", "calls")}),
    "haskell": ("a.hs", "import Data.List\ndata T = T Int\nrun x = x + 1\n", {("T", "class"), ("run", "function"), ("Data.List", "module")}, set()),
    "elixir": ("a.ex", "defmodule A do\n  alias A.B\n  def run(x) do\n    go(x)\n  end\nend\n", {("A", "class"), ("A.run", "method"), ("A.B", "module")}, {("A.run", "go", "calls")}),
    "bash": ("a.sh", "source lib.sh\nrun() {\n  go one\n}\nrun\n", {("run", "function"), ("lib.sh", "module")}, {("run", "go", "calls"), ("a.sh", "run", "calls")}),
}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_other_languages(language):
    path, text, want, links = SNIPPETS[language]
    assert REGISTRY.language(path).name == language
    symbols, edges = named(path, text)
    assert want <= set(symbols), (want - set(symbols), set(symbols))
    assert links <= edges, (links - edges, edges)


def test_registry(tmp_path):
    assert len(BUILT_IN) == 19 and REGISTRY.supports("a/b.pyi") and not REGISTRY.supports("a.PY") and not REGISTRY.supports("Makefile")
    with pytest.raises(ParseError):
        REGISTRY.language("x.unknown")
    (tmp_path / "toy.toml").write_text('extensions = ["toy"]\nfunctions = ["^to (?P<name>\\\\w+)"]\nscope = "indent"\n')
    (tmp_path / "bad.toml").write_text("extensions = 3 =")
    found, warnings = load_registry(tmp_path)
    assert found.supports("x.toy") and len(warnings) == 1
    assert load_registry(tmp_path / "none", built_in=False)[0].extensions() == []


def make_tree(root):
    files = {
        "src/base.py": "class Base:\n    def check(self):\n        return True\n",
        "src/user.py": "from base import Base\n\nclass User(Base):\n    def check(self):\n        return make()\n\ndef make():\n    return User()\n",
        "src/skip.txt": "nothing",
        "src/.hidden.py": "x = 1",
        "build/out.py": "def ignored(): pass\n",
        ".gitignore": "build/\n*.tmp\n!keep.tmp\n",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "src/broken.py").write_bytes(b"\xff\xfe\x00bad")
    (root / "keep.tmp").write_text("x")


def test_collecting_files(tmp_path):
    make_tree(tmp_path)
    assert collect_files(str(tmp_path)) == ["keep.tmp", "src/base.py", "src/broken.py", "src/skip.txt", "src/user.py"]
    assert collect_files(str(tmp_path), ["src/**/*.py", "build/*.py"], ["**/broken*"]) == ["build/out.py", "src/base.py", "src/user.py"]


def names(store):
    return {r.name for r in store.read()["symbols"].collect()}


def test_incremental_index_equals_rebuild(spark, tmp_path):
    tree = tmp_path / "tree"
    make_tree(tree)
    repo = conf.Repo("demo", str(tree), ["**/*.py"], ["build/**"])
    store = Store(spark, (tmp_path / "data").as_uri(), "org", "demo", "feature/x")
    first = index(spark, store, repo, REGISTRY)
    assert (first.files, first.skipped, first.errors) == (2, 1, 0)
    tables_ = store.read()
    links = {(a.name, b.name) for a, b in [(x, y) for e in tables_["edges"].collect() for x in tables_["symbols"].where(f"id = '{e.source}'").collect() for y in tables_["symbols"].where(f"id = '{e.target}'").collect()]}
    assert ("User", "Base") in links and ("User.check", "make") in links and ("make", "User") in links
    assert dependents(tables_["symbols"], tables_["edges"], "src/base.py").where("root_name = 'Base'").count() == 1

    (tree / "src/base.py").write_text("class Base:\n    pass\n\ndef extra():\n    return 1\n")
    (tree / "src/new.py").write_text("def call():\n    extra()\n")
    second = index(spark, store, repo, REGISTRY)
    assert (second.version, second.files) == (2, 2)
    assert "Base.check" not in names(store) and "extra" in names(store)
    (tree / "src/user.py").unlink()
    third = index(spark, store, repo, REGISTRY)
    assert third.deleted == 1 and "User" not in names(store)
    whole = Store(spark, (tmp_path / "data").as_uri(), "org", "demo", "rebuilt")
    index(spark, whole, repo, REGISTRY, force=True)
    for t in ("symbols", "edges", "raw_edges"):
        assert sorted(map(str, store.read()[t].collect())) == sorted(map(str, whole.read()[t].collect()))
    assert maintain.orphans(store.read()["symbols"], store.read()["edges"]).count() == 0
    assert ensure_fresh(spark, whole, repo, REGISTRY) is None
    assert store.rollback() == 2 and "User" in names(store)
    assert len(prune(spark, (tmp_path / "data").as_uri(), "org", 10, 4_000_000_000)) == 2 and store.version() == 0


def test_files_of_a_table_hold_ranges(spark, tmp_path):
    store = Store(spark, (tmp_path / "data").as_uri(), "org", "demo", "main")
    ids = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("source"), F.lit("t").alias("target"), F.lit("calls").alias("kind"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit({"edges": ids})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    edges = store.read()["edges"]
    assert edges.count() == 2000
    per_file = edges.groupBy(F.input_file_name().alias("f")).agg(F.min("source").alias("lo"), F.max("source").alias("hi")).orderBy("lo").collect()
    assert len(per_file) > 1
    assert all(a.hi < b.lo for a, b in zip(per_file, per_file[1:]))


def test_stream_of_files(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one(): pass\n")
    store = Store(spark, (tmp_path / "data").as_uri(), "org", "demo", "main")
    for text in ("def one(): pass\n", "def two(): one()\n"):
        (tree / f"{len(text)}.py").write_text(text)
        q = watch(spark, store, tree.as_uri(), REGISTRY, (tmp_path / "cp").as_uri(), debounce=None)
        q.awaitTermination(120)
        assert q.exception() is None
    assert {"one", "two"} <= names(store) and store.version() == 2


def test_parsing_in_parallel_and_in_sql(spark):
    files = spark.createDataFrame([("a.py", "def f(): g()\n"), ("b.py", "def (:\n"), ("c.nope", "x"), ("d.py", None), ("e.py", "")], "path string, text string")
    parts = tables(parse_files(files, REGISTRY))
    assert {r.name for r in parts["symbols"].collect()} == {"a.py", "f", "b.py", "e.py"}
    assert parts["raw_edges"].count() == 1 and [r.path for r in parts["errors"].collect()] == ["b.py"]
    register_udtf(spark, REGISTRY)
    files.createOrReplaceTempView("texts")
    assert spark.sql("select x.name from texts, lateral extract_symbols(path, text) x where x.part = 'symbol' and x.kind = 'function'").first().name == "f"


def test_reading_files(spark, tmp_path):
    make_tree(tmp_path)
    found = {r.path: r for r in read_files(spark, str(tmp_path), ["src/base.py", "src/broken.py"]).collect()}
    assert found["src/broken.py"].status == "unreadable" and found["src/base.py"].text.startswith("class Base")


CONFIG = """[organization]
name = "test-org"
[[repos]]
name = "one"
root = "/tmp/one"
include = ["src/**/*.py"]
[[deps]]
package = "lib"
repo = "one"
"""


def test_configuration(tmp_path, monkeypatch):
    c = conf.parse(CONFIG)
    assert (c.server.port, c.graph.max_hop_depth, c.repos[0].exclude) == (3100, 4, []) and conf.parse(conf.dump(c)) == c
    assert c.repo_of("/tmp/one/x").name == "one" and c.pick("one").name == "one"
    with pytest.raises(RepoNotFound):
        c.repo_of("/tmp")
    for bad in ("[x", "[server]\nport=1", CONFIG + "[server]\nnope = 1\n"):
        with pytest.raises(ConfigError):
            conf.parse(bad)
    path = conf.init("me", str(tmp_path / "c.toml"))
    with pytest.raises(ConfigError):
        conf.init("me", str(path))
    monkeypatch.setenv(conf.CONFIG_VARIABLE, str(path))
    assert conf.load().organization.name == "me"
    (tmp_path / "r/.git").mkdir(parents=True)
    with pytest.raises(ConfigError):
        conf.add_repo(c, str(tmp_path / "r"), "bad name")
    with pytest.raises(ConfigError):
        conf.add_repo(c, str(tmp_path))
    assert conf.add_repo(c, str(tmp_path / "r"), extensions=["ts", "py"]).include == ["**/*.py", "**/*.ts"]
    conf.add_dep(c, "p", "r")
    conf.remove_dep(c, "lib")
    assert [d.package for d in c.deps] == ["p"] and conf.seconds("30d") == 2_592_000
    c.deps.append(conf.Dep("q", "gone"))
    assert [d.package for d in conf.broken_deps(c)] == ["q"]


def test_enrichers(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=alice", "-c", "user.email=a@x.org", *args], check=True, capture_output=True)

    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    s = spark.createDataFrame([("1", "a.py", 1, 2), ("2", "docs/x/b.py", 1, 1)], "id string, file_path string, line_start int, line_end int")
    blame = {(r.symbol_id, r.key): r.value for r in GitBlame(str(tmp_path)).apply(s).collect()}
    assert blame[("1", "last_author")] == "alice" and ("2", "last_author") not in blame
    owners = CodeOwners(["# teams", "* @all", "docs/ @writers", "/a.py @core @ops"])
    assert {r.symbol_id: r.value for r in owners.apply(s).collect()} == {"1": "@core @ops", "2": "@writers"}
    once = enriched(spark.createDataFrame([], "symbol_id string, source string, key string, value string"), s, owners)
    assert enriched(once, s, owners).count() == 2


def test_cross_repository_links_do_not_depend_on_order(spark):
    keys = "source_repo string, source_branch string, source_symbol string, target_package string, target_path string, kind string"
    refs = spark.createDataFrame([("a", "main", "s", "lib", "lib.util.run", "imports"), ("a", "main", "t", "lib", "lib.gone", "imports"), ("a", "main", "u", "other", "other.x", "imports")], keys)
    deps = spark.createDataFrame([("lib", "lib-repo")], "package string, repo string")
    columns = "repo string, branch string, id string, name string, file_path string"
    none = spark.createDataFrame([], columns)
    offered = spark.createDataFrame([("lib-repo", "main", "9", "run", "src/lib/util.py"), ("lib-repo", "main", "8", "run", "src/else.py")], columns)
    edges, rest = crossrepo.answers(refs, deps, offered)
    assert [r.target_symbol for r in edges.collect()] == ["9"] and rest.count() == 2
    before, waiting = crossrepo.answers(refs, deps, none)
    later, left = crossrepo.reconciled(before, waiting, deps, offered)
    assert sorted(map(str, later.collect())) == sorted(map(str, edges.select(*crossrepo.EDGE_KEY).collect())) and left.count() == 2
    assert crossrepo.invalidated(later, none)[1].count() == 1
    assert {r.target_package: r["references"] for r in crossrepo.unresolved_by_package(rest).collect()} == {"lib": 1, "other": 1}
    own = spark.createDataFrame([("lib-repo", "main", "8", "9", "calls")], "repo string, branch string, source string, target string, kind string")
    assert {(r.repo, r.symbol) for r in crossrepo.impact(own, later, "lib-repo", "main", "9").collect()} == {("lib-repo", "8"), ("a", "s")}
