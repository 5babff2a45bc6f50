"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Each document has a fixed hash. A source's share is taken as whole copies of the source plus those documents whose
hash is at most a threshold. The threshold comes from histograms: sizes are summed by source and leading bits of the
hash, the bucket in which the running sum passes the budget is found, and only that bucket is summed again by its
next bits, until the threshold is exact. Nothing is sorted but the histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import checkpointed, written

#: Fixed value: a word is a run of bytes other than 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the hash, and how many of them each level of histograms resolves.
HASH_BITS = 60
LEVEL_BITS = 12

#: A table of at most so many rows, one for each source, is broadcast.
BROADCAST_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(id_col: Column, text: Column, seed: str) -> Column:
    """60 bits that depend on the seed and the id alone, or on the text where there is no id; other engines can
    compute them too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target size of each source.

    ``sizes`` has a row (__source, __total) for each source. Sources in code-point order, null last, weigh
    ``weights``, repeating. Together they are to get ``share`` times all sizes; none gets more than ``cap`` times its
    own, and what is above is dealt anew by weight among the others until none is above. That fixed point gives
    every source the lesser of its cap and its weight times one common level; the level is found in one pass over
    the sources in the order in which they reach their caps.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", F.col("__source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("__weight", weight)
        .withColumn("__cap", cap * F.col("__total"))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__budget", F.lit(share) * F.sum("__total").over(everything))
        # budget and weight that are left if all sources that come before are at their caps
        .withColumn("__left", F.col("__budget") - (F.sum("__cap").over(upto) - F.col("__cap")))
        .withColumn("__others", F.sum("__weight").over(everything) - (F.sum("__weight").over(upto) - F.col("__weight")))
        .withColumn("__level", F.col("__left") / F.col("__others"))
        .withColumn("__capped", F.col("__ratio") <= F.col("__level"))
        .withColumn("__common", F.min(F.when(~F.col("__capped"), F.struct("__ratio", F.col("__level").alias("level")))).over(everything)["level"])
        .withColumn("__target", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__common") * F.col("__weight")))
        .select("__source", "__total", "__target")
    )


def by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Rows with what ``per_source`` has in (__s, ...) for their source."""
    return rows.join(F.broadcast(per_source) if few else per_source, F.col("__source").eqNullSafe(F.col("__s")))


def thresholds(rows: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """(__source, __limit): the largest hash of which one more copy is taken, -1 for none.

    ``rows`` has (__source, __hash, __size), ``goals`` has (__source, __rest), the size that one more copy should
    have. Documents of equal hash are taken together; the last group is taken if that comes nearer to the goal.
    """
    # __low: first hash of the bucket still open; __before: size of all hashes below it
    open_ = goals.select("__source", "__rest", F.lit(0).cast("long").alias("__low"), F.lit(0).cast("long").alias("__before"))
    bits = HASH_BITS
    while bits > 0:
        step = min(LEVEL_BITS, bits)
        bits -= step
        width = 1 << bits
        span = 1 << (bits + step)
        inside = by_source(rows, open_.withColumnRenamed("__source", "__s"), few).where(
            (F.col("__hash") >= F.col("__low")) & (F.col("__hash") - F.col("__low") < F.lit(span))
        )
        histogram = inside.groupBy("__source", F.shiftright("__hash", bits).alias("__bucket")).agg(
            F.sum("__size").alias("__in"), F.max("__rest").alias("__rest"), F.max("__before").alias("__before")
        )
        upto = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = histogram.withColumn("__upto", F.col("__before") + F.sum("__in").over(upto)).withColumn("__below", F.col("__upto") - F.col("__in"))
        # the first bucket that passes the goal, else the last one that there is
        passing = running.groupBy("__source", "__rest").agg(
            F.min(F.when(F.col("__upto") >= F.col("__rest"), F.struct("__bucket", "__below", "__upto"))).alias("hit"),
            F.max(F.struct("__bucket", "__below", "__upto")).alias("last"),
        )
        found = passing.select("__source", "__rest", F.coalesce("hit", "last").alias("b")).select(
            "__source", "__rest", (F.col("b.__bucket") * F.lit(width)).alias("__low"), F.col("b.__below").alias("__before"), F.col("b.__upto").alias("__upto")
        )
        open_ = checkpointed(found) if bits else found
        if not bits:
            nearer = F.col("__upto") - F.col("__rest") <= F.col("__rest") - F.col("__before")
            return open_.select("__source", F.when(nearer, F.col("__low")).otherwise(F.col("__low") - 1).alias("__limit"))
        open_ = open_.drop("__upto")
    raise AssertionError("levels end at single hashes")


def planned(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mixture",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (__id, __source, __size, __hash), the plan of each source (__s, __total, __target, __whole, __limit), and
    whether the sources are few enough to be broadcast.

    One pass reads the texts; all further passes read a written table of ids, sources, sizes and hashes.
    """
    rows = written(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).alias("__source"),
            n_words(F.col(text_col)).alias("__size"),
            document_hash(F.col(id_col), F.col(text_col), seed).alias("__hash"),
        ),
        "mixture",
        few_files=True,
    )
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("__total"))
    whole = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(F.lit(0))
    goals = checkpointed(
        targets(sizes, weights, share, cap)
        .withColumn("__target", F.coalesce("__target", F.lit(0.0)))
        .withColumn("__whole", whole.cast("long"))
        .withColumn("__rest", F.col("__target") - F.col("__whole") * F.col("__total"))
    )
    few = goals.count() <= BROADCAST_ROWS
    limits = thresholds(rows, goals.where(F.col("__rest") > 0), few).withColumnRenamed("__source", "__s")
    plan = checkpointed(
        goals.join(limits, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
            F.col("__source").alias("__s"), "__total", "__target", "__whole", F.coalesce("__limit", F.lit(-1)).alias("__limit")
        )
    )
    return rows, plan, few


def copies() -> Column:
    """How often a row is taken, given its hash and its source's plan."""
    return F.col("__whole") + F.when(F.col("__hash") <= F.col("__limit"), F.lit(1)).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """How many words of each document the mixture takes.

    Returns a row for each row: the id, size (words; null text: 0), source_size, target (of the source), taken
    (words, repeats counted) and copies (how often the document is taken). A null source is a source of its own.
    Rows of equal id, or of equal text and no id, have equal hashes and are taken alike, so reruns agree. Sources
    without words have target 0. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows, plan, few = planned(docs, id_col=id_col, **settings)  # type: ignore[arg-type]
    return by_source(rows, plan, few).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * copies()).cast("long").alias("taken"),
        copies().alias("copies"),
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mixture", **settings: object) -> DataFrame:
    """The rows of the mixture: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    A null source is a source of its own; null and empty texts have no words and, like every row of a source without
    words, are taken as often as the source as a whole: not at all if it has none. Rows of equal id, or of equal text and
    no id, are taken alike. An empty table gives no rows. Other columns are carried along, whatever their names. The texts
    are not shuffled: a row's hash and its source's threshold decide where it stands."""
    _, plan, few = planned(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **settings)  # type: ignore[arg-type]
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(whole_row, F.col(source_col).alias("__source"), document_hash(F.col(id_col), F.col(text_col), seed).alias("__hash"))
    chosen = by_source(keyed, plan, few).withColumn("__copies", copies().cast("int")).where(F.col("__copies") > 0)
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


#: The same rows in DuckDB.
ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5('mixture:' || coalesce(doc_id::varchar, sha256(coalesce(text, '')))), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from d group by source),
r as (select *, 2.0::double * source_size as cap, (2.0::double * source_size) / w as ratio from s),
l as (
  select *,
    (1.5::double * sum(source_size) over () - (sum(cap) over (order by ratio, source nulls last rows unbounded preceding) - cap))
      / (sum(w) over () - (sum(w) over (order by ratio, source nulls last rows unbounded preceding) - w)) as level
  from r),
t as (
  select source, source_size, case when ratio <= level then cap
      else w * (select min_by(level, ratio) from l where ratio > level) end as target from l),
g as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole,
         target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest from t),
c as (
  select source, h, sum(sum(size)) over (partition by source order by h)::bigint as upto, sum(size)::bigint as own from d group by source, h),
k as (
  select c.source, max(h) as lim from c join g on c.source is not distinct from g.source
  where rest > 0 and (upto <= rest or (upto - own < rest and upto - rest <= rest - (upto - own))) group by c.source)
select d.doc_id, d.size::bigint as size, g.source_size, g.target,
       (d.size * (g.whole + case when d.h <= coalesce(k.lim, -1) then 1 else 0 end))::bigint as taken,
       (g.whole + case when d.h <= coalesce(k.lim, -1) then 1 else 0 end)::bigint as copies
from d join g on d.source is not distinct from g.source left join k on d.source is not distinct from k.source
"""
