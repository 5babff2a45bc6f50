"""Operators on small graphs, and on random ones against plain Python."""

import random
from collections import defaultdict

import pytest

from loomgraph.model import EDGES, SYMBOLS, checked, metadata_value
from loomgraph.operators import maintain, resolve, retrieve, rollup, search, traverse
from loomgraph.sources.languages import Registry


def symbols(spark, rows):
    full = [(i, n, k, f, a, b, m) for i, n, k, f, a, b, m in (r + (None,) * (7 - len(r)) if len(r) < 7 else r for r in rows)]
    return spark.createDataFrame(full, SYMBOLS)


def nodes(spark, names, path="f.py"):
    return symbols(spark, [(n, n, "function", path, i + 1, i + 1) for i, n in enumerate(names)])


def edges(spark, text):
    return spark.createDataFrame([(a, b, "calls") for a, b in (p.split(">") for p in text.split())], EDGES)


def reached(spark, graph, root, direction, depth, names="abcd"):
    return {r.id: r.depth for r in traverse.neighbors(nodes(spark, names), edges(spark, graph), root, direction, depth).collect()}


def test_chain_of_calls(spark):
    assert [len(reached(spark, "a>b b>c c>d", "a", "outgoing", d)) for d in (1, 2, 3)] == [1, 2, 3]


def test_depth_zero_is_depth_one(spark):
    assert reached(spark, "a>b b>c", "a", "outgoing", 0) == {"b": 1}


def test_fan_in_and_both_ways(spark):
    assert reached(spark, "a>b c>b", "b", "incoming", 1) == {"a": 1, "c": 1}
    assert reached(spark, "a>b b>c", "b", "both", 1) == {"a": 1, "c": 1}


def test_root_comes_back_through_cycles(spark):
    assert reached(spark, "a>a", "a", "outgoing", 1) == {"a": 1}
    assert reached(spark, "a>b b>a", "a", "outgoing", 2) == {"b": 1, "a": 2}
    assert reached(spark, "a>b", "a", "both", 2) == {"b": 1, "a": 2}
    out = traverse.neighbors(nodes(spark, "ab"), edges(spark, "a>b"), "a", "both", 2, exclude_root=True)
    assert [r.id for r in out.collect()] == ["b"]


def test_unknown_root_has_no_neighbours(spark):
    assert reached(spark, "a>b", "z", "both", 3) == {}


def test_induced_edges_are_deduplicated(spark):
    e = edges(spark, "a>b a>b b>c")
    got = traverse.subgraph(nodes(spark, "abc"), e, "a", "outgoing", 1)
    assert [(r.source, r.target) for r in got.edges.collect()] == [("a", "b")]


@pytest.mark.parametrize("ends,want", [(("a", "c"), ["a", "b", "c"]), (("a", "a"), ["a"]), (("c", "a"), None), (("a", "x"), None)])
def test_shortest_path(spark, ends, want):
    got = traverse.shortest_path(edges(spark, "a>b b>c a>d d>c c>c"), *ends).first()
    assert (got and got.trail) == want


def test_random_graphs_against_plain_search(spark):
    rng = random.Random(5)
    for _ in range(3):
        names = [f"n{i}" for i in range(14)]
        pairs = {(rng.choice(names), rng.choice(names)) for _ in range(22)}
        e = spark.createDataFrame([(a, b, "calls") for a, b in pairs], EDGES)
        root = rng.choice(names)
        for direction in ("outgoing", "incoming", "both"):
            step = defaultdict(set)
            for a, b in pairs:
                if direction != "incoming":
                    step[a].add(b)
                if direction != "outgoing":
                    step[b].add(a)
            want, frontier = {}, {root}
            for depth in (1, 2, 3):
                frontier = {y for x in frontier for y in step[x]} - set(want)
                want.update(dict.fromkeys(frontier, depth))
            got = traverse.reach(e, spark.createDataFrame([(root,)], "id string"), direction, 3).collect()
            assert {r.id: r.depth for r in got} == want


def test_search_rules(spark):
    s = symbols(spark, [("1", "foobar", "function", "a.py", 1, 1), ("2", "foo", "function", "a.py", 2, 2), ("3", "Foo", "class", "b.py", 1, 1), ("4", "É%_\\x", "type", "c.py", 1, 1)])
    assert [r.name for r in search.search(s, "foo").collect()] == ["foo", "Foo", "foobar"]
    assert [r.id for r in search.search(s, "foo", "class").collect()] == ["3"]
    assert search.search(s, "f%r").count() == 1 and search.search(s, "f_o").count() == 3
    assert search.search(s, "é").count() == 0 and search.search(s, "\\").count() == 1
    assert search.search(s, "%_", literal=True).count() == 1
    assert search.search(s, "").count() == 4 and search.search(s, "", limit=2).count() == 2


def test_context_limit_and_snippets(spark):
    s = nodes(spark, "abc")
    sources = spark.createDataFrame([("f.py", "one\r\ntwo\nthree\n")], "path string, text string")
    found = retrieve.context(s, edges(spark, "a>b b>c"), sources, "a", depth=2, context_lines=0, limit=2)
    assert found.root.first().snippet == "one"
    assert {r.id: r.snippet for r in found.neighbors.collect()} == {"b": "two", "a": "one"}
    assert [(r.source, r.target) for r in found.edges.collect()] == [("a", "b")]
    assert '"name":"a"' in found.as_json().first().json
    assert retrieve.context(s, edges(spark, "a>b"), None, "zz") is None


def test_snippets_at_the_edges(spark):
    s = symbols(spark, [("1", "x", "function", "f", 2, 3), ("2", "y", "function", "f", 9, 9), ("3", "z", "function", "gone", 1, 1), ("4", "w", "function", "f", 1, 1)])
    sources = spark.createDataFrame([("f", "a\nb\nc")], "path string, text string")
    got = {r.id: r.snippet for r in retrieve.with_snippets(s, sources, 1).collect()}
    assert got == {"1": "a\nb\nc", "2": "", "3": "", "4": "a\nb"}


def test_dependents_by_symbol(spark):
    s = symbols(spark, [("m", "f", "module", "f", 1, 1), ("a", "a", "class", "f", 1, 2), ("b", "b", "class", "f", 3, 4), ("x", "x", "class", "g", 1, 1), ("y", "y", "class", "g", 2, 2)])
    e = edges(spark, "x>a y>a b>a x>m")
    got = [(r.root, r.id, r["rank"]) for r in retrieve.dependents(s, e, "f", limit=2).collect()]
    assert sorted(got) == [("a", "b", 1), ("a", "x", 2)]


def test_resolution_stays_in_a_language_and_takes_the_last(spark):
    s = spark.createDataFrame(
        [("1", "Response", "models.py", 0), ("2", "Response", "types.ts", 0), ("3", "handler", "views.py", 0), ("4", "Response", "zz.py", 3), ("5", "Only", "types.ts", 1), ("6", "x", "noext", 0)],
        "id string, name string, file_path string, ord int",
    )
    raw = spark.createDataFrame([("3", "Response", "calls"), ("3", "Only", "calls"), ("3", "Response", "calls"), ("6", "x", "calls")], "source string, target_name string, kind string")
    got = resolve.resolve(raw, s, Registry().table(spark)).collect()
    assert [(r.source, r.target) for r in got] == [("3", "4")]


def test_delete_cascades(spark):
    s = symbols(spark, [("1", "a", "function", "t.py", 1, 1), ("2", "b", "function", "o.py", 1, 1)])
    tables = {
        "symbols": s,
        "edges": edges(spark, "1>2"),
        "files": spark.createDataFrame([("t.py", "h", 1), ("o.py", "h", 1)], "path string, content_hash string, last_indexed long"),
        "annotations": spark.createDataFrame([("1", "x", "k", "v")], "symbol_id string, source string, key string, value string"),
    }
    left = maintain.delete_files(tables, spark.createDataFrame([("t.py",)], "path string"))
    assert {n: t.count() for n, t in left.items()} == {"symbols": 1, "edges": 0, "files": 1, "annotations": 0}
    assert maintain.orphans(left["symbols"], tables["edges"]).count() == 1


def test_annotations(spark):
    columns = "symbol_id string, source string, key string, value string"
    old = spark.createDataFrame([("s", "git_blame", "last_author", "alice"), ("s", "owners", "team", "core")], columns)
    new = spark.createDataFrame([("s", "git_blame", "last_author", "bob")], columns)
    both = maintain.upsert_annotations(old, new)
    assert {(r.source, r.value) for r in maintain.annotations_of(both, "s").collect()} == {("git_blame", "bob"), ("owners", "core")}
    assert maintain.delete_annotations(both, "s", "git_blame").count() == 1
    assert maintain.nested_annotations(both).first().json == '{"git_blame":{"last_author":"bob"},"owners":{"team":"core"}}'


def test_metadata_and_kinds_are_strict(spark):
    s = symbols(spark, [("1", "a", "function", "f", 1, 1, '{"async":true,"decorator":"route"}')])
    assert checked(s).select(metadata_value("$.decorator").alias("d")).first().d == "route"
    for bad in [("1", "a", "thing", "f", 1, 1, None), ("1", "a", "class", "f", 1, 1, "{")]:
        with pytest.raises(Exception):
            checked(symbols(spark, [bad])).collect()


def test_rollup_and_status(spark):
    s = symbols(spark, [("1", "a", "function", "x/a.py", 1, 1), ("2", "b", "class", "y.ts", 1, 1), ("3", "c", "class", "x/a.py", 1, 1)])
    e = edges(spark, "1>2 3>2 1>3")
    assert {(r.name, r.ext, r.symbols) for r in rollup.file_nodes(s).collect()} == {("a.py", "py", 2), ("y.ts", "ts", 1)}
    assert [(r.source_file, r.target_file, r.weight) for r in rollup.file_links(s, e).collect()] == [("x/a.py", "y.ts", 2)]
    seen, links = rollup.visible(s, e, ["class"])
    assert seen.count() == 2 and [(r.source, r.target) for r in links.collect()] == [("3", "2")]
    assert rollup.graph_json(s, e).count() == 3 + 3 + 2 + 1
