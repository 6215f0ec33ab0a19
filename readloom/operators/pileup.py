"""Pileup mode: coverage and variants of each position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cs import describe, each_mutation
from .overlap import few_intervals, interval_hits, merged_intervals
from .scratch import small

MODES = ("all", "covered", "mutated")
#: Bases of a stretch that coverage is summed over in one window, so that a long contig spreads over tasks.
STRETCH = 1 << 20


def weighted(alignments: DataFrame, intervals: DataFrame, max_length: int) -> DataFrame:
    """Alignments that an interval hits, with w, the number of intervals that do.

    Where a contig has few intervals they travel as one array a contig, and no
    row is shuffled; else the hits are counted.
    """
    side = intervals.select("contig_id", "interval_id", "start", "end")
    a = alignments.drop(*(set(alignments.columns) - {"line_no", "contig_id", "contig_start", "contig_end", "cs", "mutations"}))
    if all(few_intervals(side)):
        arrays = side.groupBy("contig_id").agg(F.collect_list(F.struct("start", "end")).alias("iv"))
        near = lambda i: (F.col("contig_start") <= i["end"]) & ((F.col("contig_end") > i["start"]) | ((F.col("contig_end") == i["start"]) & (F.col("contig_end") - F.col("contig_start") < max_length)))
        return a.join(F.broadcast(arrays), "contig_id").withColumn("w", F.size(F.filter("iv", near)).cast("long")).where("w > 0").drop("iv")
    n = interval_hits(a.drop("cs", "mutations"), side, max_length).groupBy("line_no").agg(F.count("*").alias("w"))
    return a.join(n, "line_no")


def coverage_segments(rows: DataFrame) -> DataFrame:
    """contig_id, k, lo, hi, coverage: stretches of one coverage over 0, by a sweep over starts and ends."""
    cut = rows.withColumn("k", F.explode(F.expr(f"sequence(contig_start div {STRETCH}, (contig_end - 1) div {STRETCH})")))
    lo, hi = F.greatest("contig_start", F.col("k") * STRETCH), F.least("contig_end", (F.col("k") + 1) * STRETCH)
    events = cut.select("contig_id", "k", F.explode(F.array(F.struct(lo.alias("at"), F.col("w").alias("d")), F.struct(hi.alias("at"), (-F.col("w")).alias("d")))).alias("e"))
    steps = events.groupBy("contig_id", "k", F.col("e.at").alias("lo")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy("contig_id", "k").orderBy("lo")
    steps = steps.withColumns({"coverage": F.sum("d").over(w), "hi": F.lead("lo").over(w)})
    return steps.where("coverage > 0").select("contig_id", "k", "lo", "hi", "coverage")


def pileup_query(alignments: DataFrame, intervals: DataFrame, max_length: int, mode: str = "covered", strict: bool = False) -> DataFrame:
    """contig, position (from 1), variant, count, coverage, cumsum.

    An alignment counts once for each interval that hits it, at all positions
    of any interval. Variants come by count, then text, the reference last.
    Where variants outnumber the coverage there is no reference row, or, with
    strict, an error.
    """
    if mode not in MODES:
        raise ValueError(f"pileup mode must be one of {MODES}: {mode}")
    pool = merged_intervals(intervals).withColumn("k", F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})")))
    pool = pool.select("contig_id", "k", F.greatest("lo", F.col("k") * STRETCH).alias("lo"), F.least("hi", (F.col("k") + 1) * STRETCH).alias("hi"))
    pool, _ = small(pool, 64)
    rows = weighted(alignments, intervals, max_length)
    found = each_mutation(rows, "contig_id", "w")
    found = found.select("contig_id", F.col("m.position").alias("position"), describe(F.col("m.type"), F.col("m.nts")).alias("variant"), "w")
    found = found.withColumn("k", F.expr(f"position div {STRETCH}")).join(pool, ["contig_id", "k"]).where("position >= lo and position < hi")
    variants = found.groupBy("contig_id", "position", "variant").agg(F.sum("w").alias("count"))
    at = variants.groupBy("contig_id", "position").agg(F.sum("count").alias("varied"), F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "variant"))).alias("variants"))
    segments = coverage_segments(rows).join(pool.withColumnsRenamed({"lo": "p_lo", "hi": "p_hi"}), ["contig_id", "k"]).where("lo < p_hi and hi > p_lo")
    segments = segments.select("contig_id", F.greatest("lo", "p_lo").alias("lo"), F.least("hi", "p_hi").alias("hi"), "coverage")
    covered = segments.select("contig_id", F.explode(F.expr("sequence(lo, hi - 1)")).alias("position"), "coverage")
    if mode == "all":
        grid = pool.select("contig_id", F.explode(F.expr("sequence(lo, hi - 1)")).alias("position"))
        base = grid.join(covered, ["contig_id", "position"], "left").join(at, ["contig_id", "position"], "left")
    elif mode == "covered":
        base = covered.join(at, ["contig_id", "position"], "left")
    else:
        base = at.join(covered, ["contig_id", "position"], "left")
    base = base.withColumns({"coverage": F.coalesce("coverage", F.lit(0)).cast("long"), "varied": F.coalesce("varied", F.lit(0)).cast("long")})
    rest = F.col("coverage") - F.col("varied")
    if strict:
        rest = F.when(rest < 0, F.raise_error(F.lit("more variants than coverage")).cast("long")).otherwise(rest)
    base = base.withColumn("rest", rest)
    ref = F.col("rest") > 0
    if mode == "all":
        ref |= (F.col("coverage") == 0) & (F.col("rest") == 0)
    last = F.when(ref, F.array(F.struct((-F.col("rest")).alias("n"), F.lit("REF").alias("variant"))))
    none = F.array().cast("array<struct<n:bigint,variant:string>>")
    base = base.withColumn("rows", F.concat(F.coalesce("variants", none), F.coalesce(last, none)))
    out = base.select("contig_id", "position", "coverage", "rows", F.posexplode("rows").alias("i", "r"))
    cumsum = F.aggregate(F.slice("rows", 1, F.col("i") + 1), F.lit(0).cast("long"), lambda n, r: n - r["n"])
    return out.select(F.col("contig_id").alias("contig"), (F.col("position") + 1).alias("position"), F.col("r.variant").alias("variant"), (-F.col("r.n")).alias("count"), "coverage", cumsum.alias("cumsum"))
