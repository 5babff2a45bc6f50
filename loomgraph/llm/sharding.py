"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; a row's place is its rank as a fraction of its source; all
rows in order of place are cut into shards of equal counts. Neither ranking sorts a source or the corpus in one
task: rows are dealt into buckets by the leading part of what they are ordered by, buckets are counted, and a row's
rank is the count of all earlier buckets plus its rank within its own. Buckets have a bounded expected size, so a
source that holds a third of all rows is ranked by as many tasks as any other third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.mixture import document_hash
from loomgraph.runtime import written

#: Rows that a bucket is meant to hold.
BUCKET_ROWS = 1_000
_HASHES = float(1 << 60)


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], rank: str) -> DataFrame:
    """Adds ``rank``, the 0-based rank of each row in its group, where buckets are in order and rows within them by
    ``order``."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    # buckets are counted in blocks first, so that no task gets all buckets of a large group
    blocks = counts.withColumn("__block", F.floor(F.col(bucket) / BUCKET_ROWS)).groupBy(*group, "__block").agg(F.sum("__n").alias("__bn"))
    upto = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1) if group else None
    if upto is None:
        upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__bfirst", F.coalesce(F.sum("__bn").over(upto), F.lit(0))).drop("__bn")
    within = Window.partitionBy(*group, "__block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        counts.withColumn("__block", F.floor(F.col(bucket) / BUCKET_ROWS))
        .withColumn("__in_block", F.coalesce(F.sum("__n").over(within), F.lit(0)))
        .join(blocks, [*group, "__block"])
        .select(*group, bucket, (F.col("__bfirst") + F.col("__in_block")).alias("__first"))
    )
    here = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = rows.withColumn("__here", F.row_number().over(here) - 1)
    return numbered.join(firsts, [*group, bucket]).withColumn(rank, F.col("__first") + F.col("__here")).drop("__here", "__first")


def shard(
    docs: DataFrame, n_shards: int = 16, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The shard of each row and its slot there.

    Law ``rows``: shards' counts differ by one at most. Each source's rows are spread evenly over all shards.
    Returns a row for each row: the id, size (bytes of the text plus 1; null text: 1), text_crc32, law, shard, slot
    (gapless from 0 within a shard), grown_shard (null: under this law another shard moves rows among all), source.
    A null source is a stratum of its own. Rows of equal id and source are ordered by their texts' checksum and
    size; rows equal in all of that are interchangeable. An empty table gives no rows, and shards may stay empty if
    there are fewer rows than shards. Other columns are ignored, whatever their names.

    The texts are read once, for sizes and checksums; only rows of fixed size are shuffled.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("__id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("__source"),
            (n_bytes(F.col(text_col)) + 1).alias("__size"),
            F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("__crc"),
            document_hash(F.col(id_col), F.col(text_col), seed).alias("__hash"),
        ),
        "shard",
    )
    per_source = written(rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__n_source")), "shard-sources")
    total = per_source.agg(F.sum("__n_source")).first()[0] or 0
    # as many buckets in a source as its rows call for
    sized = rows.join(per_source, "__source").withColumn(
        "__bucket", F.floor(F.col("__hash") / F.lit(_HASHES) * F.ceil(F.col("__n_source") / BUCKET_ROWS))
    )
    tie = ["__hash", F.col("__id").asc_nulls_first(), "__crc", "__size"]
    placed = _ranked(sized, ["__source"], "__bucket", tie, "__rank").withColumn(
        "__place", (2 * F.col("__rank") + 1).cast("double") / (2 * F.col("__n_source")).cast("double")
    )
    cut = placed.withColumn("__part", F.floor(F.col("__place") * max(1, -(-total // BUCKET_ROWS))))
    spread = _ranked(cut.drop("__bucket"), [], "__part", ["__place", "__source"], "__at")
    # multiplication and division of longs as whole numbers, exact beyond 2**53
    number = F.expr(f"(__at * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(((__at * {n_shards}L) div {max(total, 1)}L) * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return spread.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        number.cast("int").alias("shard"),
        (F.col("__at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("__source") != "", F.expr("substr(__source, 2)")).alias(source_col),
    )


#: The contract's columns in DuckDB. The checksum is computed bit by bit from its polynomial.
ORACLE = """
with recursive bits(i, k, c) as (
  select range::bigint, 0, range::bigint from range(256)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
steps as (select list(c order by i) as t from bits where k = 8),
d as (
  select doc_id, coalesce('=' || source, '') as s, strlen(coalesce(text, '')) + 1 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as crc,
    ('0x' || substr(md5('shards:' || coalesce(doc_id::varchar, sha256(coalesce(text, '')))), 1, 15))::bigint as h
  from documents, steps),
r as (select *, row_number() over (partition by s order by h, doc_id nulls first, crc, size) - 1 as rank, count(*) over (partition by s) as n from d),
p as (select *, row_number() over (order by (2 * rank + 1)::double / (2 * n)::double, s) - 1 as pos, count(*) over () as total from r),
q as (select *, (pos * 16) // total as shard from p)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'rows' as law, shard::int as shard, (pos - (shard * total + 15) // 16)::bigint as slot, null::int as grown_shard from q
"""
