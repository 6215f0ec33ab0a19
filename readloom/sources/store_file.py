"""The binary store file from and to DataFrames, streamed through Spark's own file systems."""

from __future__ import annotations

import io
import struct
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cs import MUTATION, regenerate
from ..operators.scratch import scratch_path
from ..operators.store import AlignmentStore
from .binary import KINDS, MAGIC, read_store
from .paf import ALIGNMENT

ROWS = f"line_no long, read_id string, read_length long, contig_id string, contig_length long, read_start long, read_end long, contig_start long, contig_end long, is_reverse boolean, mutations array<{MUTATION}>"
#: Alignments written to the shared folder at once.
BATCH = 50_000


class _HadoopInput(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.readNBytes(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _HadoopOutput(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def load_store_file(spark: SparkSession, path: str) -> AlignmentStore:
    """The file's alignments as a store.

    The format is one sequence of records of any length, so one process reads
    it; its dictionaries, which come first, have to fit into the driver, its
    alignments pass in batches to the shared folder.
    """
    files, at = _path(spark, path)
    stream, out = files.open(at), scratch_path(spark)
    try:
        rows = read_store(io.BufferedReader(_HadoopInput(stream), 1 << 20))
        spark.createDataFrame(list(islice(rows, BATCH)), ROWS).write.parquet(out)
        while batch := list(islice(rows, BATCH)):
            spark.createDataFrame(batch, ROWS).write.mode("append").parquet(out)
    finally:
        stream.close()
    made = spark.read.schema(ROWS).parquet(out)
    return AlignmentStore(made.withColumn("cs", regenerate(F.col("mutations"), F.col("contig_start"), F.col("contig_end"))).select(*ALIGNMENT))


def save_store_file(store: AlignmentStore, path: str) -> None:
    """The store as one file; ids and mutations are numbered by first appearance.

    Numbers are joined to the alignments on executors; the driver passes rows
    on one by one, a partition at a time.
    """
    contigs, reads = store.contigs, store.reads
    mutations = store.numbered_mutations().join(contigs.select("contig_id", "contig_index"), "contig_id")
    order = _picks_in_order(store, mutations.drop("contig_index"))
    rows = store.alignments.join(reads.select("read_id", "read_index"), "read_id").join(contigs.select("contig_id", "contig_index"), "contig_id").join(order, "line_no", "left").orderBy("line_no")
    files, at = _path(store.alignments.sparkSession, path)
    stream = files.create(at, True)
    out = io.BufferedWriter(_HadoopOutput(stream), 1 << 20)
    try:
        out.write(MAGIC)
        for table, kind in ((contigs, "contig"), (reads, "read")):
            out.write(struct.pack("<Q", table.count()))
            for r in table.orderBy(f"{kind}_index").toLocalIterator():
                _text(out, r[f"{kind}_id"])
                out.write(struct.pack("<I", r["length"]))
        sizes = mutations.groupBy("contig_index").agg(F.count("*").alias("n"))
        out.write(struct.pack("<Q", sizes.count()))
        now = None
        for r in mutations.join(sizes, "contig_index").orderBy("contig_index", "mutation_index").toLocalIterator():
            if now != r["contig_index"]:
                now = r["contig_index"]
                out.write(struct.pack("<IQ", now, r["n"]))
            out.write(struct.pack("<II", KINDS.index(r["type"]), r["position"]))
            _text(out, r["nts"])
        out.write(struct.pack("<Q", store.alignments.count()))
        for r in rows.select("read_index", "contig_index", "read_start", "read_end", "contig_start", "contig_end", "is_reverse", "picks").toLocalIterator():
            picks = r["picks"] or []
            out.write(struct.pack("<IIIIII?Q", *r[:7], len(picks)) + struct.pack(f"<{len(picks)}I", *picks))
        out.flush()
    finally:
        stream.close()


def _picks_in_order(store: AlignmentStore, numbers: DataFrame) -> DataFrame:
    """line_no and the numbers of its mutations, in their order."""
    keys = ["contig_id", "type", "position", "nts"]
    m = store.parsed.select("line_no", "contig_id", F.posexplode_outer("mutations").alias("i", "m")).where("m is not null").select("line_no", "contig_id", "i", "m.*")
    found = m.join(numbers, keys).groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("i", "mutation_index"))).alias("found"))
    return found.select("line_no", F.col("found.mutation_index").alias("picks"))


def _text(out: BinaryIO, text: str) -> None:
    data = text.encode()
    out.write(struct.pack("<Q", len(data)) + data)
