"""The alignment store: a folder of Parquet tables and the queries over it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cs import each_mutation, with_mutations
from ..sources.paf import read_paf
from ..sources.sequences import read_fasta, read_sequences
from .bins import bin_query
from .full import alignment_rows, full_query, mutation_rows
from .overlap import check_intervals
from .pileup import pileup_query
from .scratch import numbered, written
from .verify import tally, verify_alignments


class AlignmentStore:
    """Alignments with their contigs, reads and greatest length.

    Alignments have mutations, or cs alone; then what a query leaves is parsed.
    """

    def __init__(self, alignments: DataFrame, max_length: int | None = None, contigs: DataFrame | None = None, reads: DataFrame | None = None):
        self.alignments = alignments
        self._max, self._contigs, self._reads, self._longest = max_length, contigs, reads, None

    @property
    def parsed(self) -> DataFrame:
        return with_mutations(self.alignments)

    @property
    def longest(self) -> DataFrame:
        """contig_id and the greatest length of an alignment on it, from one pass that is written down."""
        if self._longest is None:
            self._longest = written(self.alignments.groupBy("contig_id").agg(F.max(F.col("contig_end") - F.col("contig_start")).alias("longest")))
        return self._longest

    @property
    def max_length(self) -> int:
        if self._max is None:
            self._max = self.longest.agg(F.max("longest")).first()[0] or 0
        return self._max

    def _dictionary(self, kind: str) -> DataFrame:
        """index by first appearance, id, and the length that its first line has."""
        first = self.alignments.groupBy(f"{kind}_id").agg(F.min("line_no").alias("line_no"), F.min_by(f"{kind}_length", "line_no").alias("length"))
        return numbered(first, f"{kind}_index", "line_no").select(f"{kind}_index", f"{kind}_id", "length")

    @property
    def contigs(self) -> DataFrame:
        return self._contigs if self._contigs is not None else self._dictionary("contig")

    @property
    def reads(self) -> DataFrame:
        return self._reads if self._reads is not None else self._dictionary("read")

    def numbered_mutations(self) -> DataFrame:
        """mutation_index, contig_id, type, position, nts: each mutation of a contig once, numbered within it by first appearance."""
        m = with_mutations(self.alignments).select("line_no", "contig_id", F.posexplode_outer("mutations").alias("i", "m")).where("m is not null")
        first = m.groupBy("contig_id", F.col("m.type").alias("type"), F.col("m.position").alias("position"), F.col("m.nts").alias("nts")).agg(F.min(F.struct("line_no", "i")).alias("first"))
        every = numbered(first, "n", "contig_id", "first").drop("first")
        begin = every.groupBy("contig_id").agg(F.min("n").alias("begin"))
        return every.join(begin, "contig_id").select((F.col("n") - F.col("begin")).alias("mutation_index"), "contig_id", "type", "position", "nts")

    def mutation_dictionary(self) -> DataFrame:
        """Each mutation of a contig once."""
        m = each_mutation(self.alignments, "contig_id")
        return m.select("contig_id", F.col("m.type").alias("type"), F.col("m.position").alias("position"), F.col("m.nts").alias("nts")).distinct()

    @classmethod
    def from_paf(cls, spark: SparkSession, path: str, max_reads: int = 0, on_bad_cs: str = "fail") -> AlignmentStore:
        return cls(read_paf(spark, path, max_reads, on_bad_cs))

    @classmethod
    def build(cls, spark: SparkSession, paf: str, out: str, verify: bool = False, reads: str | None = None, contigs: str | None = None, max_reads: int = 0, quit_on_error: bool = True) -> AlignmentStore:
        """Reads, checks and saves. With verify any alignment that doesn't match its sequences raises before anything is saved: the first that is found ends the check, or, without quit_on_error, the tenth."""
        store = cls.from_paf(spark, paf, max_reads)
        if verify:
            if not (reads and contigs):
                raise ValueError("verification needs reads and contigs")
            checked = verify_alignments(store.parsed, read_sequences(spark, reads), read_fasta(spark, contigs))
            bad = checked.where(~F.col("ok")).select("line_no", "read_id", "first_mismatch").limit(1 if quit_on_error else 10).collect()
            if bad:
                raise ValueError(f"found {len(bad)} bad alignments: {[tuple(r) for r in bad]}")
        store.save(out)
        return cls.load(spark, out)

    def save(self, path: str) -> None:
        """Tables alignments (dealt by ranges of contig and start, so that row groups can be skipped), contigs, reads and stats."""
        self.parsed.repartitionByRange("contig_id", "contig_start").sortWithinPartitions("contig_id", "contig_start").write.parquet(f"{path}/alignments")
        saved = AlignmentStore(self.alignments.sparkSession.read.parquet(f"{path}/alignments"))
        saved.contigs.write.parquet(f"{path}/contigs")
        saved.reads.write.parquet(f"{path}/reads")
        self.alignments.sparkSession.range(1).select(F.lit(saved.max_length).cast("long").alias("max_length")).write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AlignmentStore:
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("alignments", "contigs", "reads", "stats")}
        return cls(t["alignments"], t["stats"].first()["max_length"], t["contigs"], t["reads"])

    def info(self) -> DataFrame:
        """One row: alignments, reads, mean read span, mutations (each occurrence) and their mean."""
        n = F.col("n")
        return self.parsed.select("read_id", "read_start", "read_end", F.size("mutations").alias("n")).agg(
            F.count("*").alias("alignments"),
            F.count_distinct("read_id").alias("reads"),
            F.coalesce(F.avg(F.col("read_end") - F.col("read_start")), F.lit(0.0)).alias("avg_alignment_length"),
            F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("mutations"),
            F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_mutations"),
        )

    def extract_alignments(self) -> DataFrame:
        return self.parsed.select("read_id", "read_start", "read_end", "contig_id", "contig_start", "contig_end", F.size("mutations").cast("long").alias("mutation_count"), "is_reverse")

    def extract_mutations(self) -> DataFrame:
        m = each_mutation(self.alignments, "read_id", "contig_id")
        return m.select("read_id", "contig_id", F.col("m.type").alias("mutation_type"), F.col("m.position").alias("contig_position"), F.col("m.nts").alias("nts"))

    def by_read_ids(self, ids: DataFrame, warn: bool = True) -> DataFrame:
        """Alignments of the reads in ids (read_id), each once; unknown ids are warned of."""
        wanted = ids.select("read_id").distinct()
        if warn:
            lost = [r["read_id"] for r in wanted.join(self.alignments.select("read_id").distinct(), "read_id", "left_anti").limit(20).collect()]
            if lost:
                warnings.warn(f"unknown reads: {lost}", stacklevel=2)
        a = with_mutations(self.alignments.join(wanted, "read_id", "left_semi"))
        return a.select(F.col("line_no").alias("alignment_index"), "read_id", "read_length", "contig_id", "read_start", "read_end", "contig_start", "contig_end", "is_reverse", F.size("mutations").cast("long").alias("num_mutations"))

    def _checked(self, intervals: DataFrame) -> DataFrame:
        check_intervals(intervals, self._contigs if self._contigs is not None else self.longest)
        return intervals

    def bins(self, intervals: DataFrame, width: int = 100) -> DataFrame:
        return bin_query(self.alignments, self._checked(intervals), width, self.max_length)

    def pileup(self, intervals: DataFrame, mode: str = "covered", strict: bool = False) -> DataFrame:
        return pileup_query(self.alignments, self._checked(intervals), self.max_length, mode, strict)

    def full(self, intervals: DataFrame, style: str | None = "by_coord", first_index: int = 0) -> tuple[DataFrame, DataFrame]:
        """Alignments and mutations."""
        rows = full_query(self.alignments, self._checked(intervals), self.max_length, style, first_index)
        return alignment_rows(rows), mutation_rows(rows)

    def verify(self, reads: DataFrame, contigs: DataFrame, max_reads: int = 0) -> DataFrame:
        a = self.alignments.where(F.col("line_no") < max_reads) if max_reads > 0 else self.alignments
        return tally(verify_alignments(a, reads, contigs))
