"""Connected components by alternating large and small stars, with a written table between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, remove, shared_dir


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) of every node of edges whose component isn't itself.

    Nodes are numbers; loops, repeats and either direction are allowed; nulls
    are left out. No component is gathered: a hub's neighbours meet only in
    grouped minima with map-side combining and in joins that Spark splits when
    they are skewed. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    path = shared_dir(spark)
    now = materialise(ends.distinct(), path)
    seen = _print(now)
    while seen[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        first = shared_dir(spark)
        large = materialise(large, first)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        second = shared_dir(spark)
        after = materialise(small, second)
        mark = _print(after)
        remove(spark, first)
        remove(spark, path)
        now, path = after, second
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
