"""Commands construct, info, extract, verify and query, with options of the form -key value."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.full import STYLES
from .operators.pileup import MODES
from .operators.store import AlignmentStore
from .sources.intervals import queried_positions, read_intervals
from .sources.sequences import fasta_lines, fastq_lines, read_fasta, read_sequences, size_mb
from .sources.single import write_text_file


def flag(text: str) -> bool:
    if text not in ("T", "F"):
        raise argparse.ArgumentTypeError("T or F")
    return text == "T"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = commands.add_parser(name, allow_abbrev=False)
        for key, kind, default in options:
            p.add_argument(f"-{key}", type=kind, default=default, required=default is ...)

    command("construct", ("ifn_paf", str, ...), ("ofn", str, ...), ("verify", flag, False), ("ifn_reads", str, None), ("ifn_contigs", str, None), ("max_reads", int, 0), ("quit_on_error", flag, True))
    command("info", ("ifn", str, ...))
    command("extract", ("ifn", str, ...), ("ofn_prefix", str, ...))
    command("verify", ("ifn_aln", str, ...), ("ifn_reads", str, ...), ("ifn_contigs", str, ...), ("max_reads", int, 0), ("ofn_contigs", str, None), ("ofn_reads", str, None))
    command("query", ("ifn_aln", str, ...), ("ifn_intervals", str, ...), ("ofn_prefix", str, ...), ("mode", str, ...), ("pileup_mode", str, "covered"), ("binsize", int, 100), ("height_style", str, "by_coord"))
    return top


def write_tsv(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header, rows in the order of df; null is empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    write_text_file(df.select(F.concat_ws("\t", *fields).alias("value")), path, "\t".join(df.columns))


def by_contig(df: DataFrame, contigs: DataFrame, *order: str) -> DataFrame:
    """df (contig, ...) in the order in which contigs appear first, then as told."""
    place = contigs.select(F.col("contig_id").alias("contig"), "contig_index")
    return df.join(place, "contig").orderBy("contig_index", *order).select(*df.columns)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    if o.command == "query":
        if o.mode not in ("full", "pileup", "bin"):
            raise SystemExit(f"unknown mode: {o.mode}")
        if o.pileup_mode not in MODES:
            raise SystemExit(f"unknown pileup_mode: {o.pileup_mode}")
        if o.mode == "full" and o.height_style not in STYLES:
            raise SystemExit(f"unknown height_style: {o.height_style}")
        if o.mode == "bin" and o.binsize <= 0:
            raise SystemExit("binsize must be over 0")
    spark = spark or SparkSession.builder.appName("readloom").getOrCreate()
    if o.command == "construct":
        AlignmentStore.build(spark, o.ifn_paf, o.ofn, o.verify, o.ifn_reads, o.ifn_contigs, o.max_reads, o.quit_on_error)
    elif o.command == "info":
        print(f"store size: {size_mb(spark, o.ifn):.1f} MB")
        for key, value in AlignmentStore.load(spark, o.ifn).info().first().asDict().items():
            print(f"{key}: {value}")
    elif o.command == "extract":
        store = AlignmentStore(AlignmentStore.load(spark, o.ifn).alignments.orderBy("line_no"))
        write_tsv(store.extract_alignments(), f"{o.ofn_prefix}_alignments.txt")
        write_tsv(store.extract_mutations(), f"{o.ofn_prefix}_mutations.txt")
    elif o.command == "verify":
        store, reads, contigs = AlignmentStore.load(spark, o.ifn_aln), read_sequences(spark, o.ifn_reads), read_fasta(spark, o.ifn_contigs)
        t = store.verify(reads, contigs, o.max_reads).first()
        print(f"bad alignments: {t['bad']} of {t['total']} ({t['percent_bad']:.2f}%)")
        used = store.alignments.where(f"line_no < {o.max_reads}") if o.max_reads > 0 else store.alignments
        if o.ofn_contigs:
            write_text_file(fasta_lines(contigs.join(used.selectExpr("contig_id as id").distinct(), "id", "left_semi")), o.ofn_contigs)
        if o.ofn_reads:
            write_text_file(fastq_lines(reads.join(used.selectExpr("read_id as id").distinct(), "id", "left_semi")), o.ofn_reads)
        return int(t["bad"] > 100)
    else:
        store, iv = AlignmentStore.load(spark, o.ifn_aln), read_intervals(spark, o.ifn_intervals)
        if o.mode == "full":
            alignments, mutations = store.full(iv, o.height_style)
            write_tsv(alignments.orderBy("alignment_index"), f"{o.ofn_prefix}_alignments.tsv")
            write_tsv(mutations.orderBy("alignment_index", "mutation_position"), f"{o.ofn_prefix}_mutations.tsv")
        elif o.mode == "pileup":
            write_tsv(by_contig(store.pileup(iv, o.pileup_mode), store.contigs, "position", "cumsum"), f"{o.ofn_prefix}_pileup.tsv")
            print(f"positions queried: {queried_positions(iv).first()['positions']}")
        else:
            write_tsv(by_contig(store.bins(iv, o.binsize), store.contigs, "bin_start"), f"{o.ofn_prefix}_bins.tsv")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
