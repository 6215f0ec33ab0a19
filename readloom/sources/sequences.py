"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paf import numbered_lines


def read_fasta(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """id, sequence of records of any number of lines; an id ends at the first space. ids (id) keeps those records alone.

    A record begins with a mark at the start of a line; marks elsewhere are text.
    """
    parts = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", r"^>|\r$", ""), r"\r?\n")
    out = parts.select(F.regexp_extract(lines[0], r"^([^ ]*)", 1).alias("id"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("sequence"))
    return out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")


def read_fastq(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """id, sequence of records of four lines; an id is the whole header."""
    lines = numbered_lines(spark, path)
    pick = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    records = lines.groupBy(F.expr("line_no div 4").alias("n")).agg(pick(0).alias("head"), pick(1).alias("sequence")).where(F.col("head").startswith("@"))
    out = records.select(F.substring("head", F.lit(2), F.length("head")).alias("id"), "sequence")
    return out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")


def sniff(spark: SparkSession, path: str) -> str:
    """fasta, fastq or unknown, by the first character."""
    first = spark.read.text(path).head(1)
    return {">": "fasta", "@": "fastq"}.get(first[0]["value"][:1] if first else "", "unknown")


def read_sequences(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    kind = sniff(spark, path)
    if kind == "unknown":
        raise ValueError(f"neither FASTA nor FASTQ: {path}")
    return (read_fasta if kind == "fasta" else read_fastq)(spark, path, ids)


def fasta_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "sequence").alias("value"))


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "sequence", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("sequence"))).alias("value"))


def write_fasta(df: DataFrame, path: str) -> None:
    """df (id, sequence) as FASTA text: a folder of files."""
    fasta_lines(df).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """df (id, sequence) as FASTQ text of quality I: a folder of files."""
    fastq_lines(df).write.text(path)


def size_mb(spark: SparkSession, path: str) -> float:
    """Size of a file or folder, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() / 2**20
