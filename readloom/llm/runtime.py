"""Shared folder, materialisation and size-checked broadcasts for the operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its measured rows times this row width stay below BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in spark.checkpoint.dir. Only where that is
    unset, as in tests on a local master, a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            base = tempfile.mkdtemp(prefix="readloom-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/readloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _ByValue:
    """Pickled, it is its model with the model's class."""

    def __init__(self, model):
        self.model = model

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.model),)


class Shared:
    """A model of bounded size for the executors, its class shipped by value with it, so that they need no copy of the library.

    A worker reads it once and keeps no pickled copy; tasks must not change it.
    """

    def __init__(self, spark: SparkSession, model):
        self._sent = spark.sparkContext.broadcast(_ByValue(model))

    @property
    def value(self):
        return self._sent.value

    def unpersist(self) -> None:
        self._sent.unpersist()


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the counted rows fit BROADCAST_BYTES; else leave the join to be shuffled."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's words, and its white space as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
