"""Interval tables: text with a header, or a DataFrame counted from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paf import numbered_lines

HEADER = "contig\tstart\tend"


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """interval_id, contig_id, start, end as written. The first line must be the header; an empty file has no intervals."""
    lines = numbered_lines(spark, path)
    head = lines.where("line_no = 0").collect()
    if head and head[0]["value"] != HEADER:
        raise ValueError(f"intervals need the header {HEADER!r}")
    rows = lines.where((F.col("line_no") > 0) & (F.trim("value") != "")).select("line_no", F.split(F.trim("value"), r"\s+").alias("f"))
    bad = F.raise_error(F.concat(F.lit("bad interval in line "), F.col("line_no").cast("string"))).cast("bigint")
    # the header takes part in no cast, whatever the order that filters run in
    number = lambda k: F.when(F.col("line_no") > 0, F.when(F.size("f") == 3, F.coalesce(F.get("f", k).try_cast("bigint"), bad)).otherwise(bad))
    return rows.select((F.col("line_no") - 1).alias("interval_id"), F.get("f", 0).alias("contig_id"), number(1).alias("start"), number(2).alias("end"))


def intervals_from(df: DataFrame, one_based: bool = True) -> DataFrame:
    """Intervals of df (contig, start, end), which may have interval_id; counted from 1 with both ends in it unless told otherwise."""
    if missing := {"contig", "start", "end"} - set(df.columns):
        raise ValueError(f"intervals need the columns {sorted(missing)}")
    if df.limit(1).count() == 0:
        raise ValueError("no intervals")
    if one_based and df.where("start <= 0 or end < start").limit(1).count():
        raise ValueError("intervals need start over 0 and end not before start")
    shift = 1 if one_based else 0
    number = F.col("interval_id").cast("bigint") if "interval_id" in df.columns else F.monotonically_increasing_id()
    return df.select(number.alias("interval_id"), F.col("contig").alias("contig_id"), (F.col("start") - shift).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def interval_text(contig: Column, start: Column, end: Column) -> Column:
    """`contig:start-end`."""
    return F.format_string("%s:%d-%d", contig, start, end)


def queried_positions(intervals: DataFrame) -> DataFrame:
    """positions: how many the intervals hold, those of several as often."""
    return intervals.agg(F.coalesce(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))), F.lit(0)).cast("bigint").alias("positions"))
