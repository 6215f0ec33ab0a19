"""Checks of alignments against their sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cs import with_mutations
from ..functions.sequences import apply_mutations, first_mismatch, fragment, reverse_complement
from .scratch import BROADCAST_BYTES, written


#: Characters of a piece of a contig, so that a fragment costs its own length wherever it lies.
PIECE = 256


def _piece_fragment(pieces: Column, start: Column, end: Column) -> Column:
    """Of a sequence in pieces what fragment gives of it whole."""
    first = F.floor(start / PIECE)
    n = F.greatest(F.floor(end / PIECE) - first + 1, F.lit(0)).cast("int")
    held = F.array_join(F.slice(pieces, (first + 1).cast("int"), n), "")
    whole = fragment(F.array_join(pieces, ""), start, end)
    return F.when(start >= 0, fragment(held, start - first * PIECE, end - first * PIECE)).otherwise(whole)


def verify_alignments(alignments: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """line_no, read_id, contig_id, the counts of mutations by type, ok and first_mismatch of every alignment.

    reads and contigs are (id, sequence). The contig's fragment with the
    mutations, turned round for reverse alignments, must equal the read's
    segment. A missing sequence raises. The fragment is cut before the reads
    are joined, so that rows never carry a whole contig through a shuffle.
    Alignments with cs alone are parsed after the joins.
    """
    there = lambda col, what: F.when(F.col(col).isNotNull(), F.col(col)).otherwise(F.raise_error(F.concat(F.lit(f"no sequence of {what} "), F.col(f"{what}_id"))))
    size = (F.octet_length("sequence") * 1.1 + 256).cast("bigint")
    c = written(contigs.select(F.col("id").alias("contig_id"), F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("contig_seq"), size.alias("size")))
    if c.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        c = F.broadcast(c)
    c = c.drop("size")
    r = reads.select(F.col("id").alias("read_id"), F.col("sequence").alias("read_seq"))
    j = alignments.join(c, "contig_id", "left").withColumn("reference", _piece_fragment(there("contig_seq", "contig"), F.col("contig_start"), F.col("contig_end"))).drop("contig_seq")
    j = j.join(r, "read_id", "left").withColumn("segment", fragment(there("read_seq", "read"), F.col("read_start"), F.col("read_end"))).drop("read_seq")
    j = with_mutations(j)
    j = j.withColumn("made", apply_mutations(F.col("reference"), F.col("mutations"), F.col("contig_start")))
    j = j.withColumn("turned", F.when(F.col("is_reverse"), reverse_complement(F.col("made.sequence"))).otherwise(F.col("made.sequence")))
    of = lambda kind: F.size(F.filter("mutations", lambda m: m["type"] == kind)).cast("long")
    ok = F.col("made.ok") & (F.col("turned") == F.col("segment"))
    return j.select("line_no", "read_id", "contig_id", of("SUB").alias("substitutions"), of("INS").alias("insertions"), of("DEL").alias("deletions"), ok.alias("ok"), first_mismatch(F.col("turned"), F.col("segment")).alias("first_mismatch"))


def tally(checked: DataFrame) -> DataFrame:
    """bad, total and percent_bad."""
    bad = F.count_if(~F.col("ok"))
    return checked.agg(bad.alias("bad"), F.count("*").alias("total"), F.coalesce(100.0 * bad / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("percent_bad"))
