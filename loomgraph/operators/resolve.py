"""From raw edges, whose targets are names, to edges between symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import extension


def with_language(symbols: DataFrame, extensions: DataFrame) -> DataFrame:
    """Symbols with the language of their files; those of no known language are dropped. The table of extensions is
    as small as the language registry."""
    return symbols.withColumn("ext", extension(F.col("file_path"))).join(F.broadcast(extensions), "ext").drop("ext")


def winners(symbols: DataFrame) -> DataFrame:
    """(name, lang, id): of symbols with one name in one language, the last by file and order within it. Symbols have
    (id, name, lang, file_path, ord)."""
    return symbols.groupBy("name", "lang").agg(F.max_by("id", F.struct("file_path", "ord", "id")).alias("id"))


def resolve(raw: DataFrame, symbols: DataFrame, extensions: DataFrame) -> DataFrame:
    """(source, target, kind), once each: raw edges whose target names a symbol of the source's language.

    ``symbols`` has ``ord``, the order in which a file's symbols were found. Everything is resolved anew from all raw
    edges, so the result doesn't depend on which files changed last.
    """
    known = with_language(symbols, extensions)
    sources = known.select(F.col("id").alias("source"), "lang").distinct()
    named = raw.select("source", "target_name", "kind").join(sources, "source")
    targets = winners(known).select(F.col("name").alias("target_name"), "lang", F.col("id").alias("target"))
    return named.join(targets, ["target_name", "lang"]).select("source", "target", "kind").distinct()


def counts(raw: DataFrame, edges: DataFrame) -> DataFrame:
    """(raw_edges, edges): how many were found and how many are left after resolution."""
    return raw.agg(F.count(F.lit(1)).alias("raw_edges")).join(edges.agg(F.count(F.lit(1)).alias("edges")))


def last_of_each(symbols: DataFrame) -> DataFrame:
    """One row for each id: of duplicates, the one found last (by ``ord``)."""
    columns = [c for c in symbols.columns if c != "id"]
    last = symbols.groupBy("id").agg(F.max_by(F.struct(*columns), F.col("ord")).alias("s"))
    return last.select("id", *[F.col(f"s.{c}").alias(c) for c in columns])


def enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str, first: str, end: str, bucket: int) -> DataFrame:
    """Each point with the innermost range of its key that holds it, null if none does.

    ``points`` has (point, key, at), ``ranges`` (range, key, first, end); a range holds what lies in [first, end), and
    the innermost is the one that begins last. Ranges are dealt into buckets of width ``bucket``, so the containment
    becomes an equality of buckets and each point meets only ranges near it.
    """
    near = ranges.select(key, "range", first, end).withColumn("__b", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor((F.col(end) - 1) / bucket))))
    held = (
        points.withColumn("__b", F.floor(F.col(at) / bucket))
        .join(near, [key, "__b"])
        .where((F.col(first) <= F.col(at)) & (F.col(at) < F.col(end)))
        .groupBy("point")
        .agg(F.max_by("range", F.struct(first, "range")).alias("range"))
    )
    return points.join(held, "point", "left").select("point", "range")
