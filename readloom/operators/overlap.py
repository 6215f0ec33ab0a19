"""Interval joins: which alignments an interval hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES

#: Bases of a bucket; intervals of a contig up to which an alignment is held against all of them.
BUCKET, FEW = 65_536, 32


def hit(max_length: Column | int) -> Column:
    """Closed touch at either end; one that ends at the start is missed if it has the store's greatest length."""
    n = F.lit(max_length) if isinstance(max_length, int) else max_length
    touches = (F.col("contig_end") == F.col("start")) & (F.col("contig_end") - F.col("contig_start") < n)
    return (F.col("contig_start") <= F.col("end")) & ((F.col("contig_end") > F.col("start")) | touches)


def check_intervals(intervals: DataFrame, contigs: DataFrame) -> None:
    """Raises on start > end and on contigs that the store hasn't."""
    bad = intervals.where("start > end or start is null or end is null").limit(1).collect()
    if bad:
        raise ValueError(f"interval with start after end: {bad[0]}")
    lost = intervals.join(contigs.select("contig_id"), "contig_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"unknown contig: {lost[0]['contig_id']}")


def few_intervals(intervals: DataFrame) -> tuple[bool, bool]:
    """Whether the intervals are counted to be small enough for a broadcast, and whether no contig has more than FEW."""
    r = intervals.groupBy("contig_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return r["total"] * 64 <= BROADCAST_BYTES, r["most"] <= FEW


def interval_hits(alignments: DataFrame, intervals: DataFrame, max_length: int, bucket: int = BUCKET, broadcast: bool | None = None) -> DataFrame:
    """Columns of alignments beside interval_id, start, end: a row for each interval that an alignment is hit by.

    Where no contig has more than FEW intervals they meet on the contig; else
    both sides are dealt over buckets of the contig, and a pair is kept in the
    first bucket that both have. Either way the intervals are broadcast only
    if they are counted to be small.
    """
    iv = intervals.select("contig_id", "interval_id", "start", "end")
    fits, few = few_intervals(iv)
    if few and fits if broadcast is None else broadcast:
        return alignments.join(F.broadcast(iv), "contig_id").where(hit(max_length))
    spread = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {bucket}"), F.expr(f"{b} div {bucket}")))
    a = alignments.withColumn("bucket", spread("contig_start", "contig_end"))
    b = iv.withColumn("bucket", spread("start", "end"))
    if fits and broadcast is None and b.count() * 64 <= BROADCAST_BYTES:
        b = F.broadcast(b)
    first = F.greatest(F.expr(f"contig_start div {bucket}"), F.expr(f"start div {bucket}"))
    return a.join(b, ["contig_id", "bucket"]).where((F.col("bucket") == first) & hit(max_length)).drop("bucket")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """contig_id, lo, hi: the positions of all intervals, overlaps and touches joined; empty intervals have none."""
    from pyspark.sql import Window as W

    w = W.partitionBy("contig_id").orderBy("start", "end")
    iv = intervals.where("start < end").withColumn("reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    iv = iv.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return iv.groupBy("contig_id", "island").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).drop("island")
