"""PAF text as it arrives: the same row-by-row parse over a stream, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paf import parse_lines


def stream_alignments(spark: SparkSession, folder: str, on_bad_cs: str = "drop", files_per_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of the alignments in files that come into folder; lines are numbered by file content, not in order."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_lines(lines.select("value", F.xxhash64("value").alias("line_no")), on_bad_cs)


def stream_bins(alignments: DataFrame, width: int) -> DataFrame:
    """Running sequenced bases and mutations of each bin of each contig; state is one row a bin."""
    bases = alignments.select("contig_id", "contig_start", "contig_end", "mutations", F.explode(F.expr(f"sequence(contig_start div {width} * {width}, (contig_end - 1) div {width} * {width}, {width}L)")).alias("bin_start"))
    bp = F.least("contig_end", F.col("bin_start") + width) - F.greatest("contig_start", "bin_start")
    inside = F.size(F.filter("mutations", lambda m: F.col("bin_start") == F.floor(m["position"] / width) * width)).cast("long")
    return bases.select("contig_id", "bin_start", bp.alias("bp"), inside.alias("m")).groupBy("contig_id", "bin_start").agg(F.sum("bp").alias("sequenced_bp"), F.sum("m").alias("mutation_count"))
