"""Graphs and tables made of the star schema, pages and documents, to run the graph operators on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import lines_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Star:
    """The star schema as a graph: regions, nations, customers, suppliers, parts and orders are symbols."""

    spark: SparkSession
    sf_dir: str

    def _rows(self, name: str, key: str, prefix: str, label: Column, kind: str, path: Column) -> DataFrame:
        line = (F.col(key) + 1).cast("int")
        return table(self.spark, self.sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), label.alias("name"), F.lit(kind).alias("kind"), path.alias("file_path"), line.alias("line_start"), line.alias("line_end")
        )

    def symbols(self) -> DataFrame:
        def under(folder: str, key: str) -> Column:
            return F.concat(F.lit(f"{folder}/"), F.col(key).cast("string"))

        parts = [
            self._rows("region", "r_regionkey", "r", F.col("r_name"), "module", F.lit("world")),
            self._rows("nation", "n_nationkey", "n", F.col("n_name"), "class", under("region", "n_regionkey")),
            self._rows("customer", "c_custkey", "c", F.col("c_name"), "method", under("nation", "c_nationkey")),
            self._rows("supplier", "s_suppkey", "s", F.col("s_name"), "function", under("nation", "s_nationkey")),
            self._rows("part", "p_partkey", "p", F.col("p_name"), "type", under("brand", "p_brand")),
            self._rows("orders", "o_orderkey", "o", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), "variable", under("cust", "o_custkey")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def edges(self, once: bool = True) -> DataFrame:
        """All edges; unless ``once``, those of a repeated pair as often as it is, which a traversal can do with."""

        def link(name: str, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
            return table(self.spark, self.sf_dir, name).select(
                F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"), F.lit(kind).alias("kind")
            )

        # keys of the small tables are unique; only pairs of lineitem repeat
        lines = link("lineitem", "o", "l_orderkey", "p", "l_partkey", "imports").unionByName(link("lineitem", "p", "l_partkey", "s", "l_suppkey", "inherits"))
        lines = lines.distinct() if once else lines
        return (
            link("nation", "n", "n_nationkey", "r", "n_regionkey", "typeof")
            .unionByName(link("customer", "c", "c_custkey", "n", "c_nationkey", "references"))
            .unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey", "references"))
            .unionByName(link("orders", "o", "o_orderkey", "c", "o_custkey", "calls"))
            .unionByName(lines)
        )


#: The same tables in SQL.
SYMBOLS_SQL = """
select 'r' || r_regionkey as id, r_name as name, 'module' as kind, 'world' as file_path, (r_regionkey + 1)::int as line_start, (r_regionkey + 1)::int as line_end from region
union all select 'n' || n_nationkey, n_name, 'class', 'region/' || n_regionkey, (n_nationkey + 1)::int, (n_nationkey + 1)::int from nation
union all select 'c' || c_custkey, c_name, 'method', 'nation/' || c_nationkey, (c_custkey + 1)::int, (c_custkey + 1)::int from customer
union all select 's' || s_suppkey, s_name, 'function', 'nation/' || s_nationkey, (s_suppkey + 1)::int, (s_suppkey + 1)::int from supplier
union all select 'p' || p_partkey, p_name, 'type', 'brand/' || p_brand, (p_partkey + 1)::int, (p_partkey + 1)::int from part
union all select 'o' || o_orderkey, 'order_' || o_orderkey, 'variable', 'cust/' || o_custkey, (o_orderkey + 1)::int, (o_orderkey + 1)::int from orders"""
EDGES_SQL = """
select 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'typeof' as kind from nation
union select 'c' || c_custkey, 'n' || c_nationkey, 'references' from customer
union select 's' || s_suppkey, 'n' || s_nationkey, 'references' from supplier
union select 'o' || o_orderkey, 'c' || o_custkey, 'calls' from orders
union select 'o' || l_orderkey, 'p' || l_partkey, 'imports' from lineitem
union select 'p' || l_partkey, 's' || l_suppkey, 'inherits' from lineitem"""


def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as symbols in files whose extension is their language: (id, name, kind, file_path, ord). A page's name
    is the first word of its title."""
    pages = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    name = F.regexp_extract("html", r"<title>([^ <]*)", 1)
    return pages.select(
        F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("id"), name.alias("name"), F.lit("module").alias("kind"), F.concat(F.lit("site/page."), lang).alias("file_path"), F.col("page_id").cast("int").alias("ord")
    )


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as raw edges (source, target_name, kind): a link's name is the last part of its path."""
    pages = table(spark, sf_dir, "pages")
    links = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    out = pages.select(F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("source"), links.alias("href"))
    return out.select("source", F.element_at(F.split("href", "/"), -1).alias("target_name"), F.lit("references").alias("kind"))


def page_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, x) for x in ("de", "en", "es", "fr")], "ext string, lang string")


PAGES_SQL = """
p_sym as (select page_id, 'g' || page_id as id, regexp_extract(html, '<title>([^ <]*)', 1) as name, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages),
p_refs as (select page_id, 'g' || page_id as source, string_split(h, '/')[-1] as target_name from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as h from pages))"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines) of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", lines_of(F.col("text")).alias("lines"))

