"""Sequences: fragments, reverse complement, mutated copies and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cs import let


def fragment(sequence: Column, start: Column, end: Column) -> Column:
    """Bases start to end, counted from 0, end not included."""
    return F.substring(sequence, (start + 1).cast("int"), (end - start).cast("int"))


def reverse_complement(sequence: Column) -> Column:
    """ACGT are complemented, all else stays; case matters."""
    return F.translate(F.reverse(sequence), "ACGT", "TGCA")


def apply_mutations(reference: Column, muts: Column, contig_start: Column) -> Column:
    """Struct of the mutated fragment and ok: whether positions fit and the reference's bases are as the mutations say.

    Works on bytes, so that a stretch costs its own length wherever it lies.
    """
    cut = lambda raw, a, z: F.substring(raw, (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
    sub, gone = lambda m: m["type"] == "SUB", lambda m: m["type"] == "DEL"
    expected = lambda m: F.when(sub(m), F.substring(m["nts"], 2, 1)).when(gone(m), m["nts"]).otherwise(F.lit(""))
    added = lambda m: F.when(sub(m), F.substring(m["nts"], 1, 1)).when(gone(m), F.lit("")).otherwise(m["nts"])
    at = lambda m: m["position"] - contig_start
    end = lambda m: at(m) + F.length(expected(m))

    def made(both: Column) -> Column:
        raw, held = both["raw"], both["held"]
        before = lambda i: F.coalesce(end(F.get(held, i - 1)), F.lit(0))
        parts = F.transform(held, lambda m, i: F.concat(cut(raw, before(i), at(m)).cast("string"), added(m)))
        fits = F.transform(held, lambda m, i: (at(m) >= before(i)) & (end(m) <= F.octet_length(raw)) & (cut(raw, at(m), end(m)).cast("string") == expected(m)))
        rest = cut(raw, before(F.size(held)), F.octet_length(raw)).cast("string")
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("sequence"), F.forall(fits, lambda x: x).alias("ok"))

    return let(F.struct(reference.cast("binary").alias("raw"), muts.alias("held")), made)


def first_mismatch(a: Column, b: Column) -> Column:
    """Index from 0 of the first difference; the shorter length if one is a prefix of the other; null if equal."""
    short = F.least(F.length(a), F.length(b))
    # Powers of two from the largest within the shorter length down: a stretch that is equal is passed.
    steps = F.transform(F.sequence(F.length(F.bin(short.cast("long"))) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    same = lambda n, step: (n + step <= short) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step))
    return F.when(a == b, F.lit(None).cast("int")).otherwise(F.aggregate(steps, F.lit(0), lambda n, step: F.when(same(n, step), n + step).otherwise(n)))
