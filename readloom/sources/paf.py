"""PAF text: lines, fields and checked alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cs import is_valid, mutations

TAG = "cs:Z:"
ALIGNMENT = ["line_no", "read_id", "read_length", "contig_id", "contig_length", "read_start", "read_end", "contig_start", "contig_end", "is_reverse", "cs", "mutations"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_no from 0 over all files in order of their names.

    A line's place is its file, the block it lies in and its order there; only
    the number of lines of each block, a row a task, is summed.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("first")).orderBy("f", "b").collect()
    rows, total = [], 0
    for r in blocks:
        rows.append((r["f"], r["b"], r["first"], total))
        total += r["n"]
    bases = spark.createDataFrame(rows, "f string, b long, first long, base long")
    return lines.join(F.broadcast(bases), ["f", "b"]).select("value", (F.col("base") + F.col("i") - F.col("first")).alias("line_no"))


def fields_of(value: Column) -> Column:
    return F.split(value, "\t")


def parse_lines(lines: DataFrame, on_bad_cs: str = "fail") -> DataFrame:
    """Alignments of lines (value, line_no); row by row, so that it serves streams as well.

    A line needs 12 fields and a tag, ends beyond starts, and a cs tag that
    regenerates to itself. Bad fields raise; a bad cs raises or, with 'drop',
    leaves the line out.
    """
    if on_bad_cs not in ("fail", "drop"):
        raise ValueError(f"on_bad_cs must be fail or drop: {on_bad_cs}")
    f = F.col("f")
    rows = lines.where(F.length("value") > 0).select("line_no", fields_of(F.col("value")).alias("f"))
    rows = rows.where(F.when(F.size("f") > 12, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too few fields in line "), F.col("line_no").cast("string")))))
    number = lambda k: F.get(f, k).cast("bigint")
    tag = F.get(F.filter(F.slice(f, 13, F.size(f)), lambda x: x.startswith(TAG)), 0)
    rows = rows.select(
        "line_no", F.get(f, 0).alias("read_id"), number(1).alias("read_length"), F.get(f, 5).alias("contig_id"), number(6).alias("contig_length"),
        number(2).alias("read_start"), number(3).alias("read_end"), number(7).alias("contig_start"), number(8).alias("contig_end"),
        (F.get(f, 4) == "-").alias("is_reverse"), F.substring(tag, F.lit(len(TAG) + 1), F.length(tag)).alias("cs"),
    )
    spans = (F.col("read_end") > F.col("read_start")) & (F.col("contig_end") > F.col("contig_start"))
    rows = rows.where(F.when(spans, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("an end isn't beyond its start in line "), F.col("line_no").cast("string")))))
    good = is_valid(F.col("cs"), F.col("contig_start"), F.col("contig_end"))
    if on_bad_cs == "fail":
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("cs doesn't match its alignment in line "), F.col("line_no").cast("string"))))
    return rows.where(good).withColumn("mutations", mutations(F.col("cs"), F.col("contig_start"))).select(*ALIGNMENT)


def read_paf(spark: SparkSession, path: str, max_reads: int = 0, on_bad_cs: str = "fail") -> DataFrame:
    """Alignments of a PAF file or folder; max_reads lines if over 0."""
    lines = numbered_lines(spark, path)
    return parse_lines(lines.where(F.col("line_no") < max_reads) if max_reads > 0 else lines, on_bad_cs)
