"""An alignment view of the driver's lineitem table, the queries over it, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cs as C
from ..functions.sequences import apply_mutations, fragment, reverse_complement
from ..operators.full import alignment_rows, full_query, mutation_rows
from ..operators.overlap import interval_hits
from ..operators.scratch import scratch_path
from ..operators.store import AlignmentStore
from ..operators.verify import tally, verify_alignments
from ..sources.intervals import HEADER, interval_text, queried_positions, read_intervals
from ..sources.paf import read_paf
from ..sources.sequences import read_sequences, sniff, write_fasta, write_fastq
from ..sources.single import write_text_file

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
#: Overlapping, touching, distant and empty intervals, the last one repeated.
INTERVALS = [(0, "ctg1", 100, 900), (1, "ctg1", 800, 1500), (2, "ctg2", 0, 500), (3, "ctg2", 500, 1000), (4, "ctg3", 19900, 25000), (5, "ctg4", 700, 700), (6, "ctg4", 700, 700)]
READS = [1, 3, 7, 32, 33, 34]

VIEW = """
select {keys},
  concat('ctg', cast(l_suppkey % 20 as string)) as contig_id, concat('read_', cast(l_orderkey as string)) as read_id,
  (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 20000 as contig_start, cast(l_quantity as int) as q,
  case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as k, l_linestatus = 'O' as is_reverse from {source}
"""
CS = "concat(':', cast(5 + q as string), case when k >= 1 then concat('*ga:', cast(q as string)) else '' end, case when k >= 2 then concat('+tt:', cast(3 + l_linenumber as string), '-ac:10') else '' end)"
SPAN = "(5 + q) + case when k >= 1 then 1 + q else 0 end + case when k >= 2 then 3 + l_linenumber + 2 + 10 else 0 end"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as alignments, not yet parsed; its line number is the key, which orders rows alike in any engine."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = spark.sql(VIEW.format(keys=", ".join(KEY), source="{rows}"), rows=rows)
    rows = rows.selectExpr(f"struct({', '.join(KEY)}) as line_no", "*", f"{CS} as cs", f"cast({SPAN} as bigint) as span")
    a = rows.select("line_no", "read_id", F.col("span").alias("read_length"), "contig_id", F.lit(20128).cast("bigint").alias("contig_length"), F.lit(0).cast("bigint").alias("read_start"), F.col("span").alias("read_end"), "contig_start", (F.col("contig_start") + F.col("span")).alias("contig_end"), "is_reverse", "cs")
    return a


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_mutations(alignments(spark, sf_dir))


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "interval_id long, contig_id string, start long, end long")


def store(spark: SparkSession, sf_dir: str) -> AlignmentStore:
    return AlignmentStore(alignments(spark, sf_dir))


def cs_mutations(spark, sf_dir):
    m = C.each_mutation(alignments(spark, sf_dir), "read_id", "contig_id", "contig_start")
    return m.select("read_id", "contig_id", "contig_start", F.col("m.type").alias("type"), F.col("m.position").alias("position"), F.col("m.nts").alias("nts"), C.describe(F.col("m.type"), F.col("m.nts")).alias("text"))


def cs_roundtrip(spark, sf_dir):
    a = parsed(spark, sf_dir)
    made = C.regenerate(F.col("mutations"), F.col("contig_start"), F.col("contig_end"))
    return a.select("read_id", "contig_id", "contig_start", made.alias("cs"), C.is_valid(F.col("cs"), F.col("contig_start"), F.col("contig_end")).alias("valid"))


def mutation_dictionary(spark, sf_dir):
    return store(spark, sf_dir).mutation_dictionary()


def mutation_keys(spark, sf_dir):
    m = C.each_mutation(alignments(spark, sf_dir), "contig_id")
    return m.groupBy(C.mutation_key(F.col("contig_id"), F.col("m")).alias("key")).agg(F.count("*").alias("n"))


def store_info(spark, sf_dir):
    return store(spark, sf_dir).info()


def contig_dictionary(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return a.groupBy("contig_id").agg(F.count("*").alias("n"), F.max(F.col("contig_end") - F.col("contig_start")).alias("max_span"), F.min_by("contig_length", "line_no").alias("length"))


def extract_alignments(spark, sf_dir):
    return store(spark, sf_dir).extract_alignments()


def extract_mutations(spark, sf_dir):
    return store(spark, sf_dir).extract_mutations()


def hits(spark, sf_dir):
    s = store(spark, sf_dir)
    return interval_hits(s.alignments, intervals(spark), s.max_length).select("interval_id", "read_id", "contig_id", "contig_start", "contig_end")


def hits_bucketed(spark, sf_dir):
    s = store(spark, sf_dir)
    return interval_hits(s.alignments, intervals(spark), s.max_length, bucket=512, broadcast=False).select("interval_id", "read_id", "contig_id", "contig_start", "contig_end")


def reads_by_id(spark, sf_dir):
    ids = spark.createDataFrame([(f"read_{i}",) for i in [*READS, READS[0]]], "read_id string")
    return store(spark, sf_dir).by_read_ids(ids, warn=False).drop("alignment_index")


def bins_100(spark, sf_dir):
    return store(spark, sf_dir).bins(intervals(spark), 100)


def bins_1000_multi(spark, sf_dir):
    return store(spark, sf_dir).bins(intervals(spark), 1000)


def bins_whole(spark, sf_dir):
    s = store(spark, sf_dir)
    iv = s.alignments.select("contig_id").distinct().select(F.xxhash64("contig_id").alias("interval_id"), "contig_id", F.lit(0).cast("long").alias("start"), F.lit(21000).cast("long").alias("end"))
    return s.bins(iv, 1000)


def _pileup(mode: str):
    def query(spark, sf_dir):
        return store(spark, sf_dir).pileup(intervals(spark), mode)

    return query


def _full(style: str | None):
    def rows(spark, sf_dir):
        s = store(spark, sf_dir)
        return full_query(s.alignments, intervals(spark), s.max_length, style)

    return rows


def full_alignments(spark, sf_dir):
    return alignment_rows(_full(None)(spark, sf_dir))


def full_mutations(spark, sf_dir):
    """With the heights by coordinate of their alignments."""
    return mutation_rows(_full("by_coord")(spark, sf_dir))


def heights_by_coord(spark, sf_dir):
    return _full("by_coord")(spark, sf_dir).select("alignment_index", "contig_id", "contig_start", "contig_end", "height")


def heights_by_mutations(spark, sf_dir):
    return _full("by_mutations")(spark, sf_dir).select("alignment_index", "contig_id", "contig_start", "contig_end", "height")


def variant_type_counts(spark, sf_dir):
    of = lambda kind: F.sum(F.size(F.filter("mutations", lambda m: m["type"] == kind))).cast("long").alias(kind.lower())
    return parsed(spark, sf_dir).groupBy("contig_id").agg(of("SUB"), of("INS"), of("DEL"))


def density_by_alignment(spark, sf_dir):
    return parsed(spark, sf_dir).select("read_id", "contig_start", C.density(F.size("mutations"), F.col("contig_start"), F.col("contig_end")).alias("density"))


def reverse_complements(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    made = F.translate(F.lpad(F.bin("p_partkey"), 20, "0"), "01", "AG")
    made = F.concat(made, F.lit("CTn"), F.substring(made, 5, 6))
    return p.select("p_partkey", made.alias("seq"), reverse_complement(made).alias("revcomp"), fragment(made, F.lit(2), F.lit(9)).alias("part"))


def applied_mutations(spark, sf_dir):
    """A reference of one letter but for what the mutations expect, changed by them."""
    a = parsed(spark, sf_dir)
    sub = F.filter("mutations", lambda m: m["type"] == "SUB")
    span = (F.col("contig_end") - F.col("contig_start")).cast("int")
    at = (F.get(sub, 0)["position"] - F.col("contig_start")).cast("int")
    plain = F.repeat(F.lit("T"), span)
    ref = F.when(F.size(sub) == 0, plain).otherwise(F.concat(F.repeat(F.lit("T"), at), F.lit("G"), F.repeat(F.lit("T"), span - at - 1)))
    dele = F.get(F.filter("mutations", lambda m: m["type"] == "DEL"), 0)["position"] - F.col("contig_start")
    ref = F.when(dele.isNull(), ref).otherwise(F.overlay(ref, F.lit("AC"), (dele + 1).cast("int")))
    made = apply_mutations(ref, F.col("mutations"), F.col("contig_start"))
    return a.select("read_id", "contig_start", "cs", made["sequence"].alias("sequence"), made["ok"].alias("ok"))


def contig_index(spark, sf_dir):
    return store(spark, sf_dir).contigs.select("contig_index", "contig_id", "length")


def read_index(spark, sf_dir):
    return store(spark, sf_dir).reads.select("read_index", "read_id", "length")


def mutation_index(spark, sf_dir):
    return store(spark, sf_dir).numbered_mutations()


def _sequences(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Reads and contigs of the letter T alone: alignments without mutations match them forwards."""
    a = alignments(spark, sf_dir)
    made = lambda kind, n: a.select(F.col(f"{kind}_id").alias("id")).distinct().withColumn("sequence", F.repeat(F.lit("T"), F.lit(n)))
    return made("read", 200), made("contig", 20128)


def verified_alignments(spark, sf_dir):
    checked = verify_alignments(alignments(spark, sf_dir), *_sequences(spark, sf_dir))
    return checked.select("read_id", "contig_id", F.col("line_no.l_partkey").alias("l_partkey"), "substitutions", "insertions", "deletions", "ok", "first_mismatch")


def verification_tally(spark, sf_dir):
    return tally(verify_alignments(alignments(spark, sf_dir), *_sequences(spark, sf_dir)))


def paf_scan(spark, sf_dir):
    """The view written as PAF text, in order, and read again."""
    a = alignments(spark, sf_dir).orderBy("line_no")
    fields = ["read_id", "read_length", "read_start", "read_end", F.when(F.col("is_reverse"), "-").otherwise("+"), "contig_id", "contig_length", "contig_start", "contig_end", F.lit("0"), F.lit("0"), F.lit("60"), F.lit("NM:i:0"), F.concat(F.lit("cs:Z:"), "cs")]
    path = scratch_path(spark)
    a.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return read_paf(spark, path).select("line_no", "read_id", "read_length", "contig_id", "contig_length", "read_start", "read_end", "contig_start", "contig_end", "is_reverse", "cs", C.mutation_count(F.col("cs")).alias("n_mutations"))


def sequence_files(spark, sf_dir):
    """Sequences of the parts written as FASTA and as FASTQ, and read again."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.format_string("p%d", "p_partkey").alias("id"), F.translate(F.bin("p_partkey"), "01", "AG").alias("sequence"))
    out = []
    for write in (write_fasta, write_fastq):
        path = scratch_path(spark)
        write(p, path)
        out.append(read_sequences(spark, path).withColumn("format", F.lit(sniff(spark, path))))
    return out[0].unionByName(out[1])


def interval_file(spark, sf_dir):
    """The intervals written as text and read again, with their text and the positions they hold."""
    path = f"{scratch_path(spark)}.txt"
    write_text_file(intervals(spark).orderBy("interval_id").select(F.concat_ws("\t", "contig_id", "start", "end").alias("value")), path, HEADER)
    iv = read_intervals(spark, path)
    return iv.select("interval_id", "contig_id", "start", "end", interval_text(F.col("contig_id"), F.col("start"), F.col("end")).alias("text")).join(F.broadcast(queried_positions(iv)))


def saved_store(spark, sf_dir):
    """A store saved and loaded: its bins."""
    path = scratch_path(spark)
    store(spark, sf_dir).save(path)
    return AlignmentStore.load(spark, path).bins(intervals(spark), 100)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (bins_1000_multi, bins_100, bins_whole, cs_mutations, cs_roundtrip, mutation_dictionary, mutation_keys, store_info, contig_dictionary, extract_alignments, extract_mutations, reads_by_id, full_alignments, full_mutations, heights_by_coord, heights_by_mutations, variant_type_counts, density_by_alignment, reverse_complements, applied_mutations, contig_index, read_index, mutation_index, verified_alignments, verification_tally, paf_scan, sequence_files, interval_file, saved_store)
} | {
    "interval_hits": hits,
    "interval_hits_bucketed": hits_bucketed,
    "pileup_all": _pileup("all"),
    "pileup_covered": _pileup("covered"),
    "pileup_mutated": _pileup("mutated"),
}

K = ", ".join(KEY)
A = f"""a as (select *, contig_start + span as contig_end from (select *, {CS} as cs, cast({SPAN} as bigint) as span from ({VIEW.format(keys=K, source="lineitem")})))"""
M = f"""o as (select *, unnest(regexp_extract_all(cs, '[:=*+~\\-][^:=*+~\\-]+')) as op, generate_subscripts(regexp_extract_all(cs, '[:=*+~\\-][^:=*+~\\-]+'), 1) as i from a),
v as (select *, case op[1] when ':' then cast(op[2:] as bigint) when '*' then 1 when '-' then len(op) - 1 else 0 end as adv from o),
p as (select *, cast(contig_start + sum(adv) over (partition by {K} order by i) - adv as bigint) as position from v),
m as (select *, case op[1] when '*' then 'SUB' when '+' then 'INS' else 'DEL' end as type, case when op[1] = '*' then upper(op[3] || op[2]) else upper(op[2:]) end as nts from p where op[1] <> ':'),
t as (select *, case type when 'SUB' then nts[1] || ':' || nts[2] when 'INS' then '+' || nts else '-' || nts end as text from m)"""
IV = "iv as (select * from (values " + ", ".join(f"({i}, '{c}', {s}, {e})" for i, c, s, e in INTERVALS) + ") as x(interval_id, contig, s, e))"
HIT = "contig_start <= e and (contig_end > s or (contig_end = s and contig_end - contig_start < (select max(contig_end - contig_start) from a)))"


def _bins_sql(ids: str, width: int, iv: str = IV) -> str:
    return f"""with {A}, {M}, {iv},
i as (select * from iv where {ids} and s < e),
g as (select distinct contig, unnest(range(s // {width} * {width}, e, {width})) as b from i),
h as (select a.*, s, e, contig from a join i on contig_id = contig and {HIT}),
x as (select contig, unnest(range(greatest(contig_start, s) // {width} * {width}, least(contig_end, e), {width})) as b, greatest(contig_start, s) as lo, least(contig_end, e) as hi from h where least(contig_end, e) > greatest(contig_start, s)),
y as (select contig, b, sum(least(hi, b + {width}) - greatest(lo, b)) as bp from x group by all),
z as (select h.contig, m.position // {width} * {width} as b, count(*) as n from h join m using ({K}) where m.position >= h.s and m.position < h.e group by all)
select g.contig, g.b::bigint as bin_start, (g.b + {width})::bigint as bin_end, {width}::bigint as bin_length, coalesce(bp, 0)::bigint as sequenced_bp, coalesce(n, 0)::bigint as mutation_count
from g left join y on y.contig = g.contig and y.b = g.b left join z on z.contig = g.contig and z.b = g.b"""


def _pileup_sql(mode: str) -> str:
    keep = {"all": "true", "covered": "coverage > 0", "mutated": "varied > 0"}[mode]
    ref = "rest > 0" + (" or (coverage = 0 and rest = 0)" if mode == "all" else "")
    return f"""with {A}, {M}, {IV},
i as (select * from iv),
pool as (select distinct contig, unnest(range(s, e)) as position from i),
w as (select {K}, count(*) as w from a join i on contig_id = contig and {HIT} group by all),
c as (select contig_id as contig, unnest(range(contig_start, contig_end)) as position, w from a join w using ({K})),
cov as (select contig, position, sum(w)::bigint as coverage from c group by all),
var as (select contig_id as contig, position, text as variant, sum(w)::bigint as n from t join w using ({K}) group by all),
base as (select pool.contig, pool.position, coalesce(coverage, 0) as coverage, coalesce((select sum(n) from var where var.contig = pool.contig and var.position = pool.position), 0)::bigint as varied from pool left join cov on cov.contig = pool.contig and cov.position = pool.position),
b as (select *, coverage - varied as rest from base where {keep}),
r as (select b.contig, b.position, variant, n, coverage, 0 as last from b join var on var.contig = b.contig and var.position = b.position
  union all select contig, position, 'REF', rest, coverage, 1 from b where {ref})
select contig, (position + 1)::bigint as position, variant, n::bigint as count, coverage::bigint as coverage, (sum(n) over (partition by contig, position order by last, n desc, variant rows unbounded preceding))::bigint as cumsum from r"""


FULL = f"""f as (select (row_number() over (order by interval_id, contig_start, {K}) - 1)::bigint as alignment_index, a.*, interval_id from a join iv on contig_id = contig and {HIT})"""
BY_COORD = f"""hs as (select alignment_index, contig_id, contig_start, contig_end, row_number() over (partition by contig_id order by contig_start, {K}, interval_id) as rn from f),
r as (select alignment_index, contig_id, contig_start, contig_end, rn, [contig_end] as ends, 0::bigint as height from hs where rn = 1
  union all select o.alignment_index, o.contig_id, o.contig_start, o.contig_end, o.rn,
    case when coalesce(list_position(list_transform(r.ends, lambda x: x <= o.contig_start), true), 0) = 0 then list_append(r.ends, o.contig_end)
      else list_transform(r.ends, lambda x, i: case when i = list_position(list_transform(r.ends, lambda y: y <= o.contig_start), true) then o.contig_end else x end) end,
    case when coalesce(list_position(list_transform(r.ends, lambda x: x <= o.contig_start), true), 0) = 0 then len(r.ends) else list_position(list_transform(r.ends, lambda x: x <= o.contig_start), true) - 1 end
  from r join hs o on o.contig_id = r.contig_id and o.rn = r.rn + 1)"""
#: The lowest level without a segment that the next one meets.
FREE = "list_filter(range(0, len(r.placed) + 1), lambda k: len(list_filter(r.placed, lambda p: p.h = k and p.e >= o.contig_start and p.s < o.contig_end)) = 0)[1]"
ORACLES: dict[str, str] = {
    "bins_1000_multi": _bins_sql("true", 1000),
    "bins_100": _bins_sql("true", 100),
    "bins_whole": _bins_sql("true", 1000, "iv as (select distinct 0 as interval_id, contig_id as contig, 0 as s, 21000 as e from a)"),
    "cs_mutations": f"with {A}, {M} select read_id, contig_id, contig_start, type, position, nts, text from t",
    "cs_roundtrip": f"with {A} select read_id, contig_id, contig_start, cs, true as valid from a",
    "mutation_dictionary": f"with {A}, {M} select distinct contig_id, type, position, nts from m",
    "mutation_keys": f"with {A}, {M} select contig_id || '_' || position || '_' || type || '_' || nts as key, count(*) as n from m group by 1",
    "store_info": f"with {A}, {M} select (select count(*) from a) as alignments, (select count(distinct read_id) from a) as reads, (select avg(span) from a) as avg_alignment_length, (select count(*) from m)::bigint as mutations, (select count(*) from m)::double / (select count(*) from a) as avg_mutations",
    "contig_dictionary": f"with {A} select contig_id, count(*) as n, max(contig_end - contig_start)::bigint as max_span, 20128::bigint as length from a group by 1",
    "extract_alignments": f"with {A}, {M}, n as (select {K}, count(*) as c from m group by all) select read_id, 0::bigint as read_start, span as read_end, contig_id, contig_start, contig_end, coalesce(c, 0)::bigint as mutation_count, is_reverse from a left join n using ({K})",
    "extract_mutations": f"with {A}, {M} select read_id, contig_id, type as mutation_type, position as contig_position, nts from m",
    "interval_hits": f"with {A}, {IV} select interval_id::bigint as interval_id, read_id, contig_id, contig_start, contig_end from a join iv on contig_id = contig and {HIT}",
    "reads_by_id": f"with {A}, {M}, n as (select {K}, count(*) as c from m group by all) select read_id, span as read_length, contig_id, 0::bigint as read_start, span as read_end, contig_start, contig_end, is_reverse, coalesce(c, 0)::bigint as num_mutations from a left join n using ({K}) where read_id in ({', '.join(repr(f'read_{i}') for i in READS)})",
    "full_alignments": f"with {A}, {M}, {IV}, {FULL}, n as (select {K}, count(*) as c from m group by all) select alignment_index, read_id, span as read_length, contig_id, 0::bigint as read_start, span as read_end, contig_start, contig_end, is_reverse, cs as cs_tag, coalesce(c, 0)::bigint as mutation_count from f left join n using ({K})",
    "full_mutations": f"with recursive {A}, {M}, {IV}, {FULL}, {BY_COORD} select f.alignment_index, f.read_id, f.contig_id, t.type as mutation_type, t.position as mutation_position, t.text as mutation_desc, r.height from f join t using ({K}) join r on r.alignment_index = f.alignment_index",
    "heights_by_coord": f"with recursive {A}, {IV}, {FULL}, {BY_COORD} select alignment_index, contig_id, contig_start, contig_end, height from r",
    "heights_by_mutations": f"""with recursive {A}, {M}, {IV}, {FULL}, n as (select {K}, count(*) as c from m group by all),
hs as (select f.alignment_index, contig_id, contig_start, contig_end, row_number() over (partition by contig_id order by (coalesce(c, 0)::double / greatest(span, 1))::float desc, {K}, interval_id) as rn from f left join n using ({K})),
r as (select alignment_index, contig_id, contig_start, contig_end, rn, 0::bigint as height, [{{'s': contig_start, 'e': contig_end, 'h': 0::bigint}}] as placed from hs where rn = 1
  union all select o.alignment_index, o.contig_id, o.contig_start, o.contig_end, o.rn, {FREE} as height, list_append(r.placed, {{'s': o.contig_start, 'e': o.contig_end, 'h': {FREE}}})
  from r join hs o on o.contig_id = r.contig_id and o.rn = r.rn + 1)
select alignment_index, contig_id, contig_start, contig_end, height from r""",
    "variant_type_counts": f"with {A}, {M}, c as (select distinct contig_id from a) select c.contig_id, count(*) filter (type = 'SUB')::bigint as sub, count(*) filter (type = 'INS')::bigint as ins, count(*) filter (type = 'DEL')::bigint as del from c left join m on m.contig_id = c.contig_id group by 1",
    "density_by_alignment": f"with {A}, {M}, n as (select {K}, count(*) as c from m group by all) select read_id, contig_start, (coalesce(c, 0)::double / greatest(span, 1))::float as density from a left join n using ({K})",
    "reverse_complements": "with s as (select p_partkey, translate(lpad(bin(p_partkey), 20, '0'), '01', 'AG') as b from part), t as (select p_partkey, b || 'CTn' || substr(b, 5, 6) as seq from s) select p_partkey, seq, translate(reverse(seq), 'ACGT', 'TGCA') as revcomp, substr(seq, 3, 7) as part from t",
    "applied_mutations": f"with {A} select read_id, contig_start, cs, repeat('T', 5 + q) || case when k >= 1 then 'A' || repeat('T', q) else '' end || case when k >= 2 then 'TT' || repeat('T', 3 + l_linenumber) || repeat('T', 10) else '' end as sequence, true as ok from a",
    "pileup_all": _pileup_sql("all"),
    "pileup_covered": _pileup_sql("covered"),
    "pileup_mutated": _pileup_sql("mutated"),
}
ORACLES["interval_hits_bucketed"] = ORACLES["interval_hits"]
ORACLES["saved_store"] = ORACLES["bins_100"]
CHECKED = "case when k = 0 and not is_reverse then null when is_reverse then 0 else 5 + q end"
ORACLES |= {
    "contig_index": f"with {A} select (row_number() over (order by f) - 1)::bigint as contig_index, contig_id, 20128::bigint as length from (select contig_id, min(row({K})) as f from a group by 1)",
    "read_index": f"with {A} select (row_number() over (order by f) - 1)::bigint as read_index, read_id, length from (select read_id, min(row({K})) as f, arg_min(span, row({K})) as length from a group by 1)",
    "mutation_index": f"with {A}, {M} select (row_number() over (partition by contig_id order by f) - 1)::bigint as mutation_index, contig_id, type, position, nts from (select contig_id, type, position, nts, min(row({K}, i)) as f from m group by all)",
    "verified_alignments": f"with {A} select read_id, contig_id, l_partkey, (k >= 1)::bigint as substitutions, (k >= 2)::bigint as insertions, (k >= 2)::bigint as deletions, k = 0 and not is_reverse as ok, ({CHECKED})::int as first_mismatch from a",
    "verification_tally": f"with {A} select count(*) filter (not (k = 0 and not is_reverse)) as bad, count(*) as total, 100.0::double * count(*) filter (not (k = 0 and not is_reverse)) / count(*) as percent_bad from a",
    "paf_scan": f"with {A} select (row_number() over (order by {K}) - 1)::bigint as line_no, read_id, span as read_length, contig_id, 20128::bigint as contig_length, 0::bigint as read_start, span as read_end, contig_start, contig_end, is_reverse, cs, case k when 0 then 0 when 1 then 1 else 3 end::bigint as n_mutations from a",
    "sequence_files": "select 'p' || p_partkey as id, translate(bin(p_partkey), '01', 'AG') as sequence, unnest(['fasta', 'fastq']) as format from part",
    "interval_file": f"with {IV} select interval_id::bigint as interval_id, contig as contig_id, s::bigint as start, e::bigint as end, contig || ':' || s || '-' || e as text, (select sum(e - s) from iv)::bigint as positions from iv",
}
