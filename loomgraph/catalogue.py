"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import catalogue_code
from loomgraph.functions.text import snippet
from loomgraph.operators import crossrepo, maintain, nearest, resolve, retrieve, rollup, search, traverse
from loomgraph.plans.star import EDGES_SQL, PAGES_SQL, SYMBOLS_SQL, Star, document_lines, page_languages, page_references, page_symbols, table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Common tables of most statements.
_GRAPH = f"with recursive g as ({SYMBOLS_SQL}),\ne as ({EDGES_SQL})"
_NODE = ["id", "name", "kind", "file_path", "line_start", "line_end"]


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        _SQL[name] = sql
        return function

    return register


# --- search and lookups ---------------------------------------------------------------------------------------------


def _register_searches() -> None:
    order = "order by case when name = '{0}' then 0 else 1 end, name, file_path, line_start, id limit 100"
    cases = {
        "search_substring": ("#00000001", None, "contains(lower(name), '#00000001')"),
        "search_kind": ("red", "type", "contains(lower(name), 'red') and kind = 'type'"),
        "search_exact_first": ("NATION_1", None, "contains(lower(name), 'nation_1') or regexp_matches(name, '(?i)nation.1')"),
        "search_wildcard": ("s%r_000000_2", None, "regexp_matches(name, '(?is)s.*r.000000.2')"),
        "search_empty": ("", None, "true"),
    }
    for name, (text, kind, where) in cases.items():

        def run(spark: SparkSession, sf_dir: str, text: str = text, kind: str | None = kind) -> DataFrame:
            return search.search(Star(spark, sf_dir).symbols(), text, kind).select(*_NODE)

        query(name, f"{_GRAPH} select * from g where {where} {order.format(text)}")(run)


_register_searches()


@query("search_repos", f"{_GRAPH} select kind as repo, id, name, rank from (select *, row_number() over (partition by kind order by case when name = 'red ring' then 0 else 1 end, name, file_path, line_start, id)::int as rank from g where contains(lower(name), 'r')) where rank <= 20")
def _search_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = Star(spark, sf_dir).symbols().withColumn("repo", F.col("kind"))
    # a query that is not exactly any name of most repositories, and a name in one of them
    found = search.search_repos(symbols, "r", limit=20)
    return found.select("repo", "id", "name", "rank")


_SQL["search_repos"] = _SQL["search_repos"].replace("'red ring'", "'r'")


@query("symbol_by_id", f"{_GRAPH} select * from g where id = 'c7'")
def _symbol_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.symbol(Star(spark, sf_dir).symbols(), "c7")


@query("exact_name", f"{_GRAPH} select * from g where name = 'red ring' order by file_path, line_start, id limit 1")
def _exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact(Star(spark, sf_dir).symbols(), "red ring")


@query("file_symbols", f"{_GRAPH} select * from g where file_path = 'nation/3'")
def _file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_symbols(Star(spark, sf_dir).symbols(), "nation/3")


@query("file_symbols_no_module", f"{_GRAPH} select * from g where file_path = 'world' and kind <> 'module'")
def _file_symbols_no_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_symbols(Star(spark, sf_dir).symbols(), "world", modules=False)


@query("path_lookup", "select 'doc/' || doc_id || '.txt' as path, sha256(coalesce(text, '')) as content_hash from documents where doc_id = 17")
def _path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")
    )
    return search.file_record(files, search.repo_path("/checkout", "/checkout/doc/17.txt"))


# --- traversal ------------------------------------------------------------------------------------------------------


def _steps(direction: str) -> str:
    out, back = "select source as a, target as b from e", "select target as a, source as b from e"
    return {"outgoing": out, "incoming": back, "both": f"{out} union {back}"}[direction]


def _walk(root: str, direction: str, depth: int) -> str:
    """Common tables: s, the steps, and w, what walks from ``root`` lead to."""
    return f"""{_GRAPH}, s as materialized ({_steps(direction)}),
w(id, depth) as (select b, 1 from s where a = '{root}' union select s.b, w.depth + 1 from w join s on s.a = w.id where w.depth < {max(depth, 1)}),
n as (select id, min(depth)::int as depth from w group by id)"""


def _register_neighbors() -> None:
    cases = [
        ("neighbors_out_d0", "o7", "outgoing", 0),
        ("neighbors_out_d1", "o7", "outgoing", 1),
        ("neighbors_out_d3", "o7", "outgoing", 3),
        ("neighbors_in_d2", "n3", "incoming", 2),
        ("neighbors_both_d1", "c7", "both", 1),
        ("neighbors_both_d2", "c7", "both", 2),
        ("neighbors_both_d3", "c7", "both", 3),
    ]
    for name, root, direction, depth in cases:

        def run(spark: SparkSession, sf_dir: str, root: str = root, direction: str = direction, depth: int = depth) -> DataFrame:
            star = Star(spark, sf_dir)
            return traverse.neighbors(star.symbols(), star.edges(once=False), root, direction, depth).select("id", "name", "kind", "depth")

        query(name, f"{_walk(root, direction, depth)} select n.id, g.name, g.kind, n.depth from n join g on g.id = n.id")(run)


_register_neighbors()


@query("induced_edges_both_d2", f"{_walk('c7', 'both', 2)}, x as (select id from n union select 'c7') select source, target, kind from e where source in (select id from x) and target in (select id from x)")
def _induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return traverse.subgraph(star.symbols(), star.edges(once=False), "c7", "both", 2).edges


def _paths(source: str, target: str, longest: int = 6) -> str:
    return f"""{_GRAPH}, t(id, trail) as (
select '{source}', ['{source}'] union all
select e.target, list_append(t.trail, e.target) from t join e on e.source = t.id where not list_contains(t.trail, e.target) and len(t.trail) <= {longest}),
best as (select trail from t where id = '{target}' order by len(trail), trail limit 1)"""


def _trail(trail: DataFrame) -> DataFrame:
    return trail.select(F.array_join("trail", ">").alias("trail"), (F.size("trail") - 1).cast("long").alias("hops"))


def _register_paths() -> None:
    for name, source, target in (("shortest_path_hit", "o7", "r1"), ("shortest_path_none", "n3", "o7"), ("shortest_path_self", "c7", "c7")):

        def run(spark: SparkSession, sf_dir: str, source: str = source, target: str = target) -> DataFrame:
            return _trail(traverse.shortest_path(Star(spark, sf_dir).edges(once=False), source, target))

        query(name, f"{_paths(source, target)} select array_to_string(trail, '>') as trail, (len(trail) - 1)::bigint as hops from best")(run)


_register_paths()


@query("chain_steps", f"{_paths('o7', 'r1')}, p as (select unnest(trail) as id, unnest(range(len(trail)))::int as pos from best) select p.pos, p.id, g.name, g.kind from p left join g on g.id = p.id")
def _chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    symbols = star.symbols()
    trail = retrieve.chain_between(symbols, star.edges(once=False), "order_7", "AMERICA")
    return traverse.chain(symbols, trail).select("pos", "id", "name", "kind")


@query("chain_kinds", f"{_paths('o7', 'n3').replace('on e.source = t.id where', chr(10) + 'on e.source = t.id where e.kind in (' + repr('calls') + ', ' + repr('references') + ') and')} select array_to_string(trail, '>') as trail, (len(trail) - 1)::bigint as hops from best")
def _chain_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trail(traverse.shortest_path(Star(spark, sf_dir).edges(once=False), "o7", "n3", kinds=["calls", "references"]))


# --- composite queries ----------------------------------------------------------------------------------------------

_CLOSEST = "row_number() over (order by n.depth, g.name, g.file_path, g.line_start, g.id)"
_TOP = f"top as (select n.id, g.name, g.kind, n.depth from (select id from g where name = 'Customer#000000007') r, n join g on g.id = n.id qualify {_CLOSEST} <= 10)"


def _context(spark: SparkSession, sf_dir: str, limit: int | None):
    star = Star(spark, sf_dir)
    return retrieve.context(star.symbols(), star.edges(once=False), None, "Customer#000000007", depth=2, limit=limit)


@query("context_d2", f"{_walk('c7', 'both', 2)} select n.id, g.name, g.kind, n.depth from n join g on g.id = n.id")
def _context_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, None).neighbors.select("id", "name", "kind", "depth")


@query("context_d2_limit10", f"{_walk('c7', 'both', 2)}, {_TOP} select * from top")
def _context_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, 10).neighbors.select("id", "name", "kind", "depth")


@query("context_edges_limit10", f"{_walk('c7', 'both', 2)}, {_TOP}, x as (select id from top union select 'c7') select e.source, e.target, e.kind, coalesce(a.name, '?') as source_name, coalesce(b.name, '?') as target_name from e left join g a on a.id = e.source left join g b on b.id = e.target where e.source in (select id from x) and e.target in (select id from x)")
def _context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.named_edges(_context(spark, sf_dir, 10).edges, Star(spark, sf_dir).symbols())


_DEPENDENTS = f"{_GRAPH}, d as (select a.id as root, a.name as root_name, b.id, b.name, 1 as depth, row_number() over (partition by a.id order by b.name, b.file_path, b.line_start, b.id)::int as rank from g a join (select distinct source, target from e) l on l.target = a.id join g b on b.id = l.source where a.file_path = 'nation/3' and a.kind <> 'module')"


@query("dependents_file_d1", f"{_DEPENDENTS} select root, root_name, id, name, depth::int as depth, rank from d")
def _dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return retrieve.dependents(star.symbols(), star.edges(once=False), "nation/3").select("root", "root_name", "id", "name", "depth", "rank")


@query("dependents_limit2_per_symbol", f"{_DEPENDENTS} select root, root_name, id, name, depth::int as depth, rank from d where rank <= 2")
def _dependents_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return retrieve.dependents(star.symbols(), star.edges(once=False), "nation/3", limit=2).select("root", "root_name", "id", "name", "depth", "rank")


_LINES_SQL = r"l as (select doc_id, case when coalesce(text, '') = '' then [] else string_split(regexp_replace(text, '\r?\n', chr(10), 'g'), chr(10)) end as v from documents), m as (select doc_id, case when len(v) > 0 and v[-1] = '' then v[:-2] else v end as v from l)"


@query("snippet_docs", f"with {_LINES_SQL} select doc_id, len(v)::int as n_lines, case when len(v) >= 1 then array_to_string(v[1:least(4, len(v))], chr(10)) else '' end as snippet from m")
def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return lines.select("doc_id", F.size("lines").alias("n_lines"), snippet(F.col("lines"), F.lit(2), F.lit(3), 1).alias("snippet"))


# --- resolution -----------------------------------------------------------------------------------------------------

_RESOLVED_SQL = f"with {PAGES_SQL}, win as (select name, lang, arg_max(id, page_id) as id from p_sym group by name, lang), hit as (select distinct r.source, w.id as target from p_refs r join p_sym s on s.page_id = r.page_id join win w on w.name = r.target_name and w.lang = s.lang)"


@query("page_refs_resolved", f"{_RESOLVED_SQL} select source, target, 'references' as kind from hit")
def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(page_references(spark, sf_dir), page_symbols(spark, sf_dir), page_languages(spark))


@query("page_refs_unresolved_cross_lang", f"with {PAGES_SQL} select distinct r.source, r.target_name from p_refs r join p_sym s on s.page_id = r.page_id where exists (select 1 from p_sym t where t.name = r.target_name) and not exists (select 1 from p_sym t where t.name = r.target_name and t.lang = s.lang)")
def _cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = resolve.with_language(page_symbols(spark, sf_dir), page_languages(spark))
    named = page_references(spark, sf_dir).join(symbols.select(F.col("id").alias("source"), "lang"), "source")
    names = symbols.select(F.col("name").alias("target_name"))
    known = symbols.select(F.col("name").alias("target_name"), "lang")
    return named.join(names, "target_name", "left_semi").join(known, ["target_name", "lang"], "left_anti").select("source", "target_name").distinct()


@query("raw_edge_counts", f"{_RESOLVED_SQL} select (select count(*) from p_refs)::bigint as raw_edges, (select count(*) from hit)::bigint as edges")
def _raw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.counts(page_references(spark, sf_dir), _resolved(spark, sf_dir))


def _clock(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp without time zone."""
    return (F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")


@query(
    "enclosing_scope",
    """with t as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as sec from events),
r as (select event_id as rid, user_id, sec as lo, sec + (event_id % 7 + 1) * 3600 as hi from t where event_type = 'signup')
select t.event_id as point, (select r.rid from r where r.user_id = t.user_id and r.lo <= t.sec and t.sec < r.hi order by r.lo desc, r.rid desc limit 1) as "range"
from t where event_type <> 'signup'""",
)
def _enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _clock(F.col("ts")).alias("at"))
    ranges = timed.where("event_type = 'signup'").select(
        F.col("event_id").alias("range"), "user_id", F.col("at").alias("first"), (F.col("at") + (F.col("event_id") % 7 + 1) * 3600).alias("stop")
    )
    points = timed.where("event_type <> 'signup'").select(F.col("event_id").alias("point"), "user_id", "at")
    return resolve.enclosing(points, ranges, "user_id", "at", "first", "stop", 4 * 3600)


# --- roll-ups -------------------------------------------------------------------------------------------------------


@query("file_rollup_nodes", f"{_GRAPH} select file_path, string_split(file_path, '/')[-1] as name, regexp_extract(file_path, '[^/]\\.([^./]+)$', 1) as ext, count(*)::bigint as symbols from g group by file_path")
def _file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.file_nodes(Star(spark, sf_dir).symbols())


@query("file_rollup_links", f"{_GRAPH} select a.file_path as source_file, b.file_path as target_file, e.kind, count(*)::bigint as weight from e join g a on a.id = e.source join g b on b.id = e.target where a.file_path <> b.file_path group by all")
def _file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return rollup.file_links(star.symbols(), star.edges())


@query("visible_subgraph_kinds", f"{_GRAPH}, v as (select id from g where kind in ('function', 'class')) select source, target, kind from e where source in (select id from v) and target in (select id from v)")
def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    return rollup.visible(star.symbols(), star.edges())[1]


@query("highlighted_nodes", f"{_GRAPH} select id, name, least(30.0, 4 + sqrt(line_start) * 2)::double as radius from g where contains(lower(name), 'nation_1')")
def _highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Star(spark, sf_dir).symbols()
    return rollup.highlighted(nodes, "NATION_1").select("id", "name", rollup.node_size(F.col("line_start")).alias("radius"))


_REPO_EDGES = "re as (select g.kind as repo, count(*) as edges from e join g on g.id = e.source group by g.kind)"


@query("status_counts", f"{_GRAPH}, {_REPO_EDGES}, rs as (select kind as repo, count(*) as symbols from g group by kind), r(repo) as (select kind from g union select 'empty') select r.repo, case when rs.repo is not null then 'main' end as branch, coalesce(rs.symbols, 0)::bigint as symbols, coalesce(re.edges, 0)::bigint as edges, rs.repo is not null as indexed from r left join rs on rs.repo = r.repo left join re on re.repo = r.repo")
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    symbols = star.symbols().withColumns({"repo": F.col("kind"), "branch": F.lit("main")})
    edges = star.edges().join(symbols.select(F.col("id").alias("source"), "repo", "branch"), "source")
    repos = symbols.select("repo").distinct().unionByName(spark.createDataFrame([("empty",)], "repo string"))
    return retrieve.status(symbols, edges, repos)


@query("status_rollup", f"{_GRAPH} select split_part(file_path, '/', 1) as repo, kind, count(*)::bigint as symbols from g group by rollup(split_part(file_path, '/', 1), kind)")
def _status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.status_rollup(Star(spark, sf_dir).symbols().withColumn("repo", F.split("file_path", "/")[0]))


@query("ext_census", r"with u as (select regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') as path from pages), x as (select regexp_extract(path, '[^/]\.([^./]+)$', 1) as ext from u) select ext, count(*)::bigint as files, case when ext = 'html' then 'markup' end as lang, ext = 'html' as covered from x where ext <> '' group by ext")
def _ext_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://[^/]*", "").alias("path"))
    return rollup.extension_census(paths, spark.createDataFrame([("html", "markup")], "ext string, lang string"))


# --- maintenance ----------------------------------------------------------------------------------------------------


@query("upsert_symbols", f"{_GRAPH} select id, case when kind = 'class' then lower(name) else name end as name, kind, file_path, line_start, line_end from g union all select 'x' || n_nationkey, 'new', 'class', 'region/x', 1, 1 from nation")
def _upsert_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Star(spark, sf_dir).symbols()
    changed = old.where("kind = 'class'").withColumn("name", F.lower("name"))
    fresh = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("new").alias("name"), F.lit("class").alias("kind"), F.lit("region/x").alias("file_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end")
    )
    return maintain.upsert_symbols(old, changed.unionByName(fresh))


@query("upsert_edges_dedupe", f"{_GRAPH} select * from e union select target, source, 'calls' from e where kind = 'references'")
def _upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Star(spark, sf_dir).edges()
    back = old.where("kind = 'references'").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("calls").alias("kind"))
    return maintain.upsert_edges(old, old.unionByName(back))


@query(
    "delete_file_cascade",
    f"{_GRAPH}, x as (select id from g where file_path in ('nation/3', 'brand/Brand#11')) select 'symbol' as part, id as a, kind as b from g where id not in (select id from x) "
    "union all select 'edge', source || '>' || target, kind from e where source not in (select id from x) and target not in (select id from x) "
    "union all select 'annotation', id, 'name' from g where id not in (select id from x) union all select distinct 'file', file_path, '' from g where file_path not in ('nation/3', 'brand/Brand#11')",
)
def _delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    symbols = star.symbols()
    tables = {
        "symbols": symbols,
        "edges": star.edges(),
        "annotations": symbols.select(F.col("id").alias("symbol_id"), F.lit("star").alias("source"), F.lit("name").alias("key"), F.col("name").alias("value")),
        "files": symbols.select(F.col("file_path").alias("path")).distinct(),
    }
    left = maintain.delete_files(tables, spark.createDataFrame([("nation/3",), ("brand/Brand#11",)], "path string"))
    return (
        left["symbols"].select(F.lit("symbol").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"))
        .unionByName(left["edges"].select(F.lit("edge").alias("part"), F.concat_ws(">", "source", "target").alias("a"), F.col("kind").alias("b")))
        .unionByName(left["annotations"].select(F.lit("annotation").alias("part"), F.col("symbol_id").alias("a"), F.col("key").alias("b")))
        .unionByName(left["files"].select(F.lit("file").alias("part"), F.col("path").alias("a"), F.lit("").alias("b")))
    )


_LABELS_SQL = "a as (select 'd' || doc_id as symbol_id, 'labels' as source, 'quality' as key, quality::varchar as value from labels union all select 'd' || doc_id, 'labels', 'toxic', toxic::varchar from labels)"


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    id_ = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("symbol_id")
    made = [labels.select(id_, F.lit("labels").alias("source"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("quality", "toxic")]
    return made[0].unionByName(made[1])


@query("annotations_upsert", f"with {_LABELS_SQL} select symbol_id, source, key, case when key = 'toxic' then 'seen' else value end as value from a union all select distinct symbol_id, 'review', 'state', 'open' from a")
def _annotations_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _annotations(spark, sf_dir)
    new = old.where("key = 'toxic'").withColumn("value", F.lit("seen"))
    review = old.select("symbol_id", F.lit("review").alias("source"), F.lit("state").alias("key"), F.lit("open").alias("value")).distinct()
    return maintain.upsert_annotations(old, new.unionByName(review))


@query("annotations_delete", f"with {_LABELS_SQL} select * from a where not (symbol_id = (select 'd' || min(doc_id) from labels) and source = 'labels')")
def _annotations_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "labels").agg(F.min("doc_id")).first()[0]
    return maintain.delete_annotations(_annotations(spark, sf_dir), f"d{first}", "labels")


@query("annotations_nested", f"with {_LABELS_SQL} select symbol_id, '{{\"labels\":{{' || string_agg('\"' || key || '\":\"' || value || '\"', ',' order by key) || '}}}}' as json from a group by symbol_id")
def _annotations_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.nested_annotations(_annotations(spark, sf_dir))


_VERSIONS_SQL = """k as (select 'doc/' || doc_id as path, sha256(coalesce(text, '') || case when doc_id % 7 = 1 then 'x' else '' end) as h from documents where doc_id % 7 <> 0),
f as (select 'doc/' || doc_id as path, sha256(coalesce(text, '')) as h from documents where doc_id % 7 <> 2),
c as (select coalesce(k.path, f.path) as path, case when k.path is null then 'new' when f.path is null then 'deleted' when k.h = f.h then 'unchanged' else 'changed' end as status from k full join f on k.path = f.path)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one tree: in the first some files aren't there yet and some have other texts; in the second some
    are gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.col("doc_id") % 7
    before = docs.where(part != 0).select("path", F.sha2(F.concat("text", F.when(part == 1, "x").otherwise("")), 256).alias("content_hash"))
    after = docs.where(part != 2).select("path", F.sha2("text", 256).alias("content_hash"))
    return maintain.changes(before, after)


def _register_versions() -> None:
    for name, states in (("changed_files", ("new", "changed")), ("deleted_files", ("deleted",)), ("unchanged_files", ("unchanged",))):

        def run(spark: SparkSession, sf_dir: str, states: tuple[str, ...] = states) -> DataFrame:
            return _versions(spark, sf_dir).where(F.col("status").isin(*states))

        quoted = ", ".join(f"'{s}'" for s in states)
        query(name, f"with {_VERSIONS_SQL} select path, status from c where status in ({quoted})")(run)


_register_versions()

# --- across repositories --------------------------------------------------------------------------------------------

_CROSS_SQL = """refs as (select distinct 'parts' as source_repo, 'main' as source_branch, 'p' || l_partkey as source_symbol, 'pkg' || s_nationkey as target_package,
  'lib.' || (s_suppkey % 5) || '.' || s_name as target_path, 'imports' as kind, s_nationkey, s_suppkey from lineitem join supplier on s_suppkey = l_suppkey),
cross_e as (select source_repo, source_branch, source_symbol, 'nation/' || s_nationkey as target_repo, 'main' as target_branch, 's' || s_suppkey as target_symbol, kind from refs where s_nationkey < 20)"""


def _cross(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts are one repository; each nation's suppliers are another, and a package of their own. There are packages
    that no dependency names."""
    suppliers = table(spark, sf_dir, "supplier")
    shelf = (F.col("s_suppkey") % 5).cast("string")
    symbols = suppliers.select(
        F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("repo"), F.lit("main").alias("branch"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("src/lib/"), shelf, F.lit("/all.x")).alias("file_path")
    )
    used = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    references = used.select(
        F.lit("parts").alias("source_repo"), F.lit("main").alias("source_branch"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_symbol"),
        F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string")).alias("target_package"), F.concat(F.lit("lib."), shelf, F.lit("."), F.col("s_name")).alias("target_path"), F.lit("imports").alias("kind"),
    )
    deps = spark.createDataFrame([(f"pkg{n}", f"nation/{n}") for n in range(20)], "package string, repo string")
    return crossrepo.answers(references, deps, symbols)


@query("cross_repo_resolved", f"with {_CROSS_SQL} select * from cross_e")
def _cross_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir)[0]


@query("cross_repo_unresolved", f"with {_CROSS_SQL} select source_repo, source_branch, source_symbol, target_package, target_path, kind from refs where s_nationkey >= 20")
def _cross_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cross(spark, sf_dir)[1]


@query("unresolved_by_package", f"with {_CROSS_SQL} select target_package, count(*)::bigint as \"references\", count(distinct source_symbol)::bigint as sources from refs where s_nationkey >= 20 group by target_package")
def _by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrepo.unresolved_by_package(_cross(spark, sf_dir)[1])


_PARTS_EDGES = "select distinct 'p' || l_partkey as target, 'o' || l_orderkey as source from lineitem"


@query("cross_repo_impact", f"with {_CROSS_SQL}, own as ({_PARTS_EDGES}), root as (select target_repo, target_symbol from cross_e order by target_symbol limit 1), a as (select distinct source_symbol as symbol from cross_e where target_symbol = (select target_symbol from root)) select 'parts' as repo, 'main' as branch, symbol, 1 as depth from a union all select distinct 'parts', 'main', own.source, 2 from own join a on a.symbol = own.target")
def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = _cross(spark, sf_dir)[0]
    first = cross.orderBy("target_symbol").first()
    own = table(spark, sf_dir, "lineitem").select(
        F.lit("parts").alias("repo"), F.lit("main").alias("branch"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("imports").alias("kind")
    )
    return crossrepo.impact(own, cross, first["target_repo"], first["target_branch"], first["target_symbol"], 2)


# --- vectors --------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors, vectors.orderBy("id").first()["embedding"]


_KNN = "v as (select vec_id as id, embedding::double[] as x from embeddings), q as (select x from v order by id limit 1), s as (select id, list_cosine_similarity(v.x, q.x) as y from v, q), k as (select id, y, row_number() over (order by y desc, id) as rank from s)"


@query("knn_cosine_top10", f"with {_KNN} select id, round(y, 6) as similarity from k where rank <= 10")
def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, wanted = _vectors(spark, sf_dir)
    return nearest.nearest(vectors, wanted, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("combined_context", f"with {_KNN}, b as (select id, rank from k where rank <= 20 union all select id, row_number() over (order by id) from v qualify row_number() over (order by id) <= 20), f as (select id, round(sum(1.0::double / (60 + rank)), 9) as score from b group by id) select * from f order by score desc, id limit 20")
def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, wanted = _vectors(spark, sf_dir)
    from pyspark.sql import Window

    near = nearest.nearest(vectors, wanted, 20)
    semantic = near.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "id")))
    first = vectors.select("id").orderBy("id").limit(20)
    structural = first.withColumn("rank", F.row_number().over(Window.orderBy("id")))
    return nearest.combined(structural, semantic).select("id", F.round("score", 9).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood of one customer."""
    star = Star(spark, sf_dir)
    found = retrieve.context(star.symbols(), star.edges(once=False), None, "Customer#000000007", depth=2)
    return traverse.in_order(found.neighbors).select(*_NODE, "depth")


def queries() -> dict[str, Query]:
    return {**_QUERIES, **catalogue_code.queries()}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **catalogue_code.oracle_sql()}
