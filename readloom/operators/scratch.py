"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its counted rows times the row width given stay below this.
BROADCAST_BYTES = 32 << 20


def scratch_path(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="readloom-")
    return f"{base.rstrip('/')}/readloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it is counted to fit, and whether it does."""
    fits = df.count() * row_bytes <= BROADCAST_BYTES
    return (F.broadcast(df) if fits else df), fits


def numbered(df: DataFrame, name: str, *order, start: int = 0) -> DataFrame:
    """df with the number of each row in the order given.

    Rows are dealt by ranges and numbered within each; only the counts of the
    ranges, one row a partition, are summed on the driver.
    """
    part = F.shiftright(F.col("_place"), 33)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    total, bases = start, []
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        bases.append((r["p"], total))
        total += r["n"]
    before = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    rows = placed.join(F.broadcast(before), part == F.col("_part"))  # a row a partition
    return rows.withColumn(name, F.col("_base") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_base")
