"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import WORD, materialise, maybe_broadcast

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target, n).

    The level water filling reaches: a source takes weight * level words, or
    most * source_size if that is less. Sources fill up in order of
    most * size / weight, so the level follows from running sums over that
    order. Works on one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))
    s = sizes.withColumn("weight", F.get(weight, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    rest = W.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(W.partitionBy()),
            "below": F.coalesce(F.sum("source_size").over(rest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(rest.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.lit(most) * F.col("below")) / F.col("open")
    s = s.withColumn("level", F.max(F.when(level <= F.col("full_at"), level)).over(W.partitionBy()))
    target = F.least(F.col("weight") * F.col("level"), (F.lit(most) * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(seed: str, name: Column) -> Column:
    """One offset in [0, 1) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(name, F.lit("\u0000"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each document of docs (doc_id, text, source), and the columns to carry.

    Within a source every document expects target / source_size copies. The
    documents stand in order of size (ties: md5 of the id, the id), so that
    the systematic sample is spread over all sizes. The expected copies are
    summed along that order, one offset is added, and a document is emitted
    once for each integer its interval crosses.

    The prefix sum is distributed: rows are dealt by ranges of (source, size,
    hash), so a source of any size spreads over many tasks; each task numbers
    its own rows and only its counts per source are added up.

    Null text has size 0; null source is a source of its own, last in order;
    an empty table gives an empty result; repeated rows are separate rows. A
    source without words has target 0 and no copies.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    if not carry:
        rows = materialise(rows)  # else the ranges' sampling would count all words once more
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), "size", "h", "doc_id"]
    placed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("h"))
    part = F.shiftright(F.col("place"), 33)
    counts = placed.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("size").alias("words"))
    # at most (partitions + sources) rows: the ranges hold each source in one run of partitions
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n"))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    bases = _with_targets(counts, source_targets(sizes, weights, most))
    bases = materialise(bases.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "first", "before", "source_size", "target"))
    on = placed["source"].eqNullSafe(F.col("b_source")) & (part == F.col("b_part"))
    joined = placed.join(maybe_broadcast(bases, 160), on)
    rank = F.col("before") + F.col("place") - F.col("first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = uniform(seed, F.col("source"))
    crossed = F.floor((rank + 1) * rate + shift) - F.floor(rank * rate + shift)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"), *[F.col(f"carried_{c}") for c in carry])


def repeat_rows(docs: DataFrame) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    mixed = systematic_mix(docs, carry=tuple(docs.columns)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"carried_{c}").alias(c) for c in docs.columns])


def _with_targets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "t_source")
    return counts.join(t, counts["source"].eqNullSafe(t["t_source"])).drop("t_source")


def mix_query(docs: DataFrame) -> DataFrame:
    """op5: what the mix takes of each document, in words."""
    mixed = systematic_mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB; integers cross as in the operator, with the same doubles.
MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
f as (select *, (3 * source_size)::double / weight as full_at, sum(source_size) over ()::bigint as total from w),
g as (select *, coalesce(sum(source_size) over (order by full_at, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as below,
  sum(weight) over (order by full_at, source asc nulls last rows between current row and unbounded following)::bigint as open_w from f),
l as (select *, max(case when (total - 3 * below)::double / open_w <= full_at then (total - 3 * below)::double / open_w end) over () as level from g),
t as (select source, source_size, coalesce(least(weight * level, (3 * source_size)::double), 0.0) as target,
  (('0x' || substr(md5('mix-1|' || coalesce(source, chr(0))), 1, 8))::bigint)::double / 4294967296.0 as shift from l),
r as (select d.doc_id, d.size, t.source_size, t.target, t.shift, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
  row_number() over (partition by d.source order by d.size, md5(coalesce(d.doc_id::varchar, '')), d.doc_id) - 1 as rnk
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * least(3, floor((rnk + 1) * rate + shift)::bigint - floor(rnk * rate + shift)::bigint))::bigint as taken from r
"""
