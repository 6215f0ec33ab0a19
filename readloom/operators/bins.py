"""Bin mode: bases and mutations in bins of one width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cs import each_mutation
from .overlap import interval_hits


def bin_query(alignments: DataFrame, intervals: DataFrame, width: int, max_length: int) -> DataFrame:
    """contig, bin_start, bin_end, bin_length, sequenced_bp, mutation_count.

    Counts add up over intervals and are clipped to each; every bin that an
    interval touches has a row. Both counts go through one grouped sum.
    """
    if width <= 0:
        raise ValueError("the width of bins must be over 0")
    iv = intervals.where("start < end")
    of = lambda x: f"({x}) div {width} * {width}"
    grid = iv.select("contig_id", F.explode(F.expr(f"sequence({of('start')}, {of('end - 1')}, {width}L)")).alias("bin_start")).select("*", F.lit(0).cast("long").alias("bp"), F.lit(0).cast("long").alias("m"))
    hits = interval_hits(alignments.drop(*(set(alignments.columns) - {"contig_id", "contig_start", "contig_end", "cs", "mutations"})), iv, max_length)
    clipped = hits.withColumns({"lo": F.greatest("contig_start", "start"), "hi": F.least("contig_end", "end")})
    bases = clipped.where("hi > lo").select("contig_id", "lo", "hi", F.explode(F.expr(f"sequence({of('lo')}, {of('hi - 1')}, {width}L)")).alias("bin_start"))
    bases = bases.select("contig_id", "bin_start", (F.least("hi", F.col("bin_start") + width) - F.greatest("lo", "bin_start")).alias("bp"), F.lit(0).cast("long").alias("m"))
    found = each_mutation(hits, "contig_id", "start", "end").where("m.position >= start and m.position < end").select("contig_id", F.expr(of("m.position")).alias("bin_start"), F.lit(0).cast("long").alias("bp"), F.lit(1).cast("long").alias("m"))
    total = grid.unionAll(bases).unionAll(found).groupBy("contig_id", "bin_start").agg(F.sum("bp").alias("sequenced_bp"), F.sum("m").alias("mutation_count"))
    return total.select(F.col("contig_id").alias("contig"), "bin_start", (F.col("bin_start") + width).alias("bin_end"), F.lit(width).cast("long").alias("bin_length"), "sequenced_bp", "mutation_count")
