"""Difference strings (cs): operations, mutations, text, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUTATION = "struct<type:string,position:bigint,nts:string>"
#: Fixed values of the format: one operation, a whole valid string, and two matches in a row.
OPERATION = r"[:=*+~\-][^:=*+~\-]+"
VALID = r"^(:[1-9][0-9]*|\*[a-z]{2}|\+[a-z]+|-[a-z]+)+$"
ADJACENT = r":[0-9]+:"


def operations(cs: Column) -> Column:
    """The operations in order, each with its sign; a sign without a value is left out."""
    return F.regexp_extract_all(cs, F.lit(OPERATION), F.lit(0))


def _advance(op: Column) -> Column:
    """Reference bases that an operation passes."""
    sign = F.substring(op, 1, 1)
    return F.when(sign == ":", F.substring(op, F.lit(2), F.length(op)).cast("bigint")).when(sign == "*", F.lit(1)).when(sign == "-", F.length(op) - 1).otherwise(F.lit(0)).cast("bigint")


def reference_span(cs: Column) -> Column:
    return F.aggregate(operations(cs), F.lit(0).cast("bigint"), lambda n, op: n + _advance(op))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Operations that one running array is built over: longer strings are cut into about as many parts as a part has operations.
PART = 128


def _sign(op: Column) -> Column:
    return F.substring(op, 1, 1)


def _mutations_from(ops: Column, start: Column) -> Column:
    first = F.struct(start.alias("at"), F.array().cast(f"array<{MUTATION}>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        sign, value = _sign(op), F.upper(F.substring(op, F.lit(2), F.length(op)))
        nts = F.when(sign == "*", F.reverse(value)).otherwise(value)
        kind = F.when(sign == "*", "SUB").when(sign == "+", "INS").otherwise("DEL")
        new = F.struct(kind.alias("type"), acc["at"].alias("position"), nts.alias("nts"))
        return F.struct((acc["at"] + _advance(op)).alias("at"), F.when(sign == ":", acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    return F.aggregate(ops, first, step, lambda acc: acc["out"])


def mutations(cs: Column, contig_start: Column) -> Column:
    """Array of mutations at contig positions.

    A substitution's nts are the read's base and the reference's; an insertion
    stands on the base to its right; all are in upper case. The steps grow
    with the operations to the power 1.5: where a part of a long string begins
    follows from the sums of the parts before it.
    """
    start = contig_start.cast("bigint")

    def in_parts(ops: Column) -> Column:
        size = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(ops))).cast("int"))
        parts = F.transform(F.sequence(F.lit(1), F.size(ops), size), lambda i: F.slice(ops, i, size))
        spans = lambda held: F.transform(held, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda n, op: n + _advance(op)))
        before = lambda sums, k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0).cast("bigint"), lambda n, x: n + x)
        return let(parts, lambda held: let(spans(held), lambda sums: F.flatten(F.transform(held, lambda part, k: _mutations_from(part, start + before(sums, k))))))

    return let(operations(cs), lambda ops: F.when(F.size(ops) <= PART, _mutations_from(ops, start)).otherwise(in_parts(ops)))


def with_mutations(rows: DataFrame) -> DataFrame:
    """rows with mutations, parsed from cs where they aren't there yet. Joins come first: what is parsed is what they leave."""
    return rows if "mutations" in rows.columns else rows.withColumn("mutations", mutations(F.col("cs"), F.col("contig_start")))


def mutation_count(cs: Column) -> Column:
    """Number of mutations of a valid string, from its signs alone."""
    return (F.length(cs) - F.length(F.translate(cs, "*+-", ""))).cast("bigint")


def each_mutation(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and m, a row for each mutation. (explode alone would have its array made once more for a filter.)"""
    return with_mutations(rows).select(*keep, F.explode_outer("mutations").alias("m")).where("m is not null")


def _end(m: Column) -> Column:
    """The contig position after a mutation."""
    return m["position"] + F.when(m["type"] == "SUB", F.lit(1)).when(m["type"] == "DEL", F.length(m["nts"])).otherwise(F.lit(0)).cast("bigint")


def _end_before(muts: Column, i: Column, start: Column) -> Column:
    """The end of the mutation before the one at i; start for the first."""
    return F.coalesce(_end(F.get(muts, i - 1)), start)


def regenerate(muts: Column, contig_start: Column, contig_end: Column) -> Column:
    """The cs string of mutations in order: lower case, gaps as matches."""
    gap = lambda n: F.when(n > 0, F.concat(F.lit(":"), n.cast("string"))).otherwise(F.lit(""))
    start = contig_start.cast("bigint")

    def text(held: Column) -> Column:
        def part(m: Column, i: Column) -> Column:
            sign = F.when(m["type"] == "SUB", "*").when(m["type"] == "INS", "+").otherwise("-")
            nts = F.lower(F.when(m["type"] == "SUB", F.reverse(m["nts"])).otherwise(m["nts"]))
            return F.concat(gap(m["position"] - _end_before(held, i, start)), sign, nts)

        return F.concat(F.array_join(F.transform(held, part), ""), gap(contig_end.cast("bigint") - _end_before(held, F.size(held), start)))

    return let(muts, text)


def is_valid(cs: Column, contig_start: Column, contig_end: Column) -> Column:
    """True where regenerating would give the same string: form, no two matches in a row, and the span."""
    form = cs.isNotNull() & cs.rlike(VALID) & ~cs.rlike(ADJACENT)
    return F.coalesce(F.when(form, reference_span(cs) == contig_end - contig_start), F.lit(False))


def describe(kind: Column, nts: Column) -> Column:
    """`R:F` (read base first) of a substitution, `+NTS`, `-NTS`."""
    sub = F.when(F.length(nts) < 2, F.lit("ERR_SUB")).otherwise(F.concat(F.substring(nts, 1, 1), F.lit(":"), F.substring(nts, 2, 1)))
    return F.when(kind == "SUB", sub).when(kind == "INS", F.concat(F.lit("+"), nts)).when(kind == "DEL", F.concat(F.lit("-"), nts)).otherwise(F.lit("UNK"))


def mutation_key(contig: Column, mutation: Column) -> Column:
    """Text that tells a contig's mutations apart."""
    return F.concat_ws("_", contig, mutation["position"], mutation["type"], mutation["nts"])


def density(n_mutations: Column, contig_start: Column, contig_end: Column) -> Column:
    """Mutations per base of the span, in 32 bits."""
    return (n_mutations / F.greatest(contig_end - contig_start, F.lit(1))).cast("float")
