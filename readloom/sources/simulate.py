"""Synthetic alignments, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate_paf(spark: SparkSession, n: int = 100, contig: str = "contig1", contig_length: int = 10_000, low: int = 1, high: int = 1_000, length: int = 100, most: int = 3, seed: int = 0) -> DataFrame:
    """value, line_no: PAF lines of forward alignments of one length with up to `most` mutations at distinct places.

    Every draw is a hash of the seed, the line and what is drawn, so lines
    don't depend on how rows are dealt to tasks.
    """

    def draw(what, bound):
        return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *what), F.lit(bound))

    base = lambda i, k: F.substring(F.lit("acgt"), (draw((F.lit(k), i), 4) + 1).cast("int"), F.lit(1))
    rows = spark.range(1, n + 1).withColumns({"start": draw((F.lit("start"),), high - low - length + 1) + low, "k": draw((F.lit("k"),), most + 1)})
    places = F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: draw((F.lit("at"), j), length))))
    rows = rows.withColumn("places", F.slice(places, 1, F.col("k").cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("cs"), F.lit(0).alias("n"))

    def step(acc, p):
        kind = draw((F.lit("kind"), p), 3)
        gap = F.when(p > acc["at"], F.concat(F.lit(":"), (p - acc["at"]).cast("string"))).otherwise(F.lit(""))
        sub = F.concat(F.lit("*"), base(p, "ref"), base(p, "read"))
        text = F.when(kind == 0, sub).when(kind == 1, F.concat(F.lit("+"), base(p, "read"))).otherwise(F.concat(F.lit("-"), base(p, "ref")))
        use = p >= acc["at"]
        return F.when(use, F.struct(F.when(kind == 1, p).otherwise(p + 1).alias("at"), F.concat(acc["cs"], gap, text).alias("cs"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    rows = rows.withColumn("a", F.aggregate("places", start, step))
    tail = F.when(F.col("a.at") < length, F.concat(F.lit(":"), (length - F.col("a.at")).cast("string"))).otherwise(F.lit(""))
    fields = [F.concat(F.lit("read_"), "id"), F.lit(length), F.lit(0), F.lit(length), F.lit("+"), F.lit(contig), F.lit(contig_length), F.col("start"), F.col("start") + length]
    fields += [length - F.col("a.n"), F.lit(length), F.lit(60), F.concat(F.lit("NM:i:"), F.col("a.n").cast("string")), F.concat(F.lit("cs:Z:"), "a.cs", tail)]
    return rows.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"), (F.col("id") - 1).alias("line_no"))
