import random
import time
from collections import Counter

import model
import pytest
from pyspark.sql import functions as F

from readloom.functions import cs as C
from readloom.functions.sequences import apply_mutations
from readloom.operators.full import full_query, stack_by_coord, stack_by_mutations
from readloom.operators.overlap import interval_hits
from readloom.operators.pileup import pileup_query
from readloom.operators.store import AlignmentStore
from readloom.operators.verify import verify_alignments

INTERVALS = [(0, "c0", 20, 90), (1, "c0", 60, 130), (2, "c0", 130, 160), (3, "c1", 50, 50), (4, "c1", 0, 120), (5, "c1", 0, 120)]
SCHEMA = "line_no long, read_id string, read_length long, contig_id string, contig_length long, read_start long, read_end long, contig_start long, contig_end long, is_reverse boolean, cs string"


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return model.random_alignments(request.param)


@pytest.fixture
def store(spark, rows):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    return AlignmentStore(df.withColumn("mutations", C.mutations(F.col("cs"), F.col("contig_start"))))


@pytest.fixture
def intervals(spark):
    return spark.createDataFrame(INTERVALS, "interval_id long, contig_id string, start long, end long")


def test_mutations_and_way_back(store, rows):
    got = store.alignments.select("line_no", "mutations", "cs", C.regenerate(F.col("mutations"), F.col("contig_start"), F.col("contig_end")).alias("again"), C.is_valid(F.col("cs"), F.col("contig_start"), F.col("contig_end")).alias("ok")).collect()
    for r in got:
        assert [tuple(m) for m in r["mutations"]] == rows[r["line_no"]]["muts"]
        assert r["again"] == r["cs"] and r["ok"]


def test_mutation_count(store, rows):
    got = store.alignments.select("line_no", C.mutation_count(F.col("cs")).alias("n")).collect()
    assert {r["line_no"]: r["n"] for r in got} == {r["line_no"]: len(r["muts"]) for r in rows}


def test_invalid_strings(spark):
    bad = ["", ":0", ":3:4", "*a", "*AC", "+", ":5=acg", "~gt3ac", ":4", None]
    df = spark.createDataFrame([(s,) for s in bad], "cs string").select(C.is_valid(F.col("cs"), F.lit(0), F.lit(5)).alias("ok"))
    assert not any(r["ok"] for r in df.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_hits(store, intervals, rows, broadcast):
    got = interval_hits(store.alignments, intervals, store.max_length, bucket=16, broadcast=broadcast).select("interval_id", "line_no").collect()
    assert sorted(map(tuple, got)) == sorted((iv[0], r["line_no"]) for iv, r in model.hits(rows, INTERVALS))


@pytest.mark.parametrize("width", [7, 50])
def test_bins(store, intervals, rows, width):
    got = store.bins(intervals, width).select("contig", "bin_start", "sequenced_bp", "mutation_count").collect()
    assert sorted(map(tuple, got)) == model.bins(rows, INTERVALS, width)


@pytest.mark.parametrize("mode", ["all", "covered", "mutated"])
def test_pileup(store, intervals, rows, mode):
    got = store.pileup(intervals, mode).collect()
    assert sorted(map(tuple, got)) == sorted(model.pileup(rows, INTERVALS, mode))


@pytest.mark.parametrize("style", ["by_coord", "by_mutations"])
def test_full_and_heights(store, intervals, rows, style):
    got = full_query(store.alignments, intervals, store.max_length, style).orderBy("alignment_index").collect()
    order = sorted(model.hits(rows, INTERVALS), key=lambda x: (x[0][0], x[1]["contig_start"], x[1]["line_no"]))
    assert [(r["interval_id"], r["line_no"]) for r in got] == [(iv[0], r["line_no"]) for iv, r in order]
    assert [r["alignment_index"] for r in got] == list(range(len(order)))
    by_line = sorted(range(len(got)), key=lambda i: (got[i]["line_no"], got[i]["interval_id"]))
    want = model.heights([(got[i]["contig_id"], got[i]["contig_start"], got[i]["contig_end"], got[i]["mutation_count"]) for i in by_line], style)
    assert [got[i]["height"] for i in by_line] == want


def test_levels_touch():
    assert stack_by_coord([0, 5, 5, 6], [5, 9, 7, 8]) == [0, 0, 1, 2]


def test_levels_by_mutations():
    """Against a walk over all levels, in bands of 64 levels too; and deep stacks in about the time of as many shallow ones."""
    rng = random.Random(3)
    for most in (0, 1, 20, 200):
        s = [rng.randrange(60) for _ in range(400)]
        e = [x + rng.randrange(most + 1) for x in s]
        levels, want = [], []
        for a, z in zip(s, e):
            k = next((k for k, held in enumerate(levels) if not any(q >= a and p < z for p, q in held)), len(levels))
            levels += [[]] * (k == len(levels))
            levels[k] = [*levels[k], (a, z)]
            want.append(k)
        assert stack_by_mutations(s, e) == stack_by_mutations(s, e, memory=1) == want
    took = []
    for span in (1_000_000, 1000):
        s = [rng.randrange(span) for _ in range(30_000)]
        begin = time.process_time()
        stack_by_mutations(s, [x + rng.randrange(6, 140) for x in s])
        took.append(time.process_time() - begin)
    assert took[1] < 4 * took[0] + 1


def test_errors(store, intervals, spark):
    with pytest.raises(ValueError):
        store.bins(spark.createDataFrame([(0, "nowhere", 0, 5)], intervals.schema))
    with pytest.raises(ValueError):
        store.pileup(spark.createDataFrame([(0, "c0", 9, 5)], intervals.schema))
    with pytest.raises(ValueError):
        store.bins(intervals, 0)
    with pytest.raises(ValueError):
        pileup_query(store.alignments, intervals, 1, "some")


def test_verify_cuts_before_the_reads(spark):
    """Fragments across pieces of a contig, first differences by place, and no whole contig in the join of the reads."""
    rng = random.Random(8)
    contig = "".join(rng.choice("ACGT") for _ in range(3000))
    rows, reads, want = [], [], {}
    for i, (s, e) in enumerate([(0, 5), (0, 3000), (250, 260), (255, 256), (256, 512), (700, 1900), (2990, 3000), (2999, 3005), (3500, 3600)]):
        for wrong in (None, 0, 3):
            seq = contig[s:e]
            bad = wrong is not None and wrong < len(seq)
            seq = seq[:wrong] + "n" + seq[wrong + 1 :] if bad else seq
            n = f"r{i}_{wrong}"
            rows.append((len(rows), n, len(seq), "c", 3000, 0, len(seq), s, e, False, f":{e - s}"))
            reads.append((n, seq))
            want[n] = (not bad, wrong if bad else None)
    checked = verify_alignments(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(reads, "id string, sequence string"), spark.createDataFrame([("c", contig)], "id string, sequence string"))
    assert {r["read_id"]: (r["ok"], r["first_mismatch"]) for r in checked.collect()} == want
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "contig_seq" not in plan[: plan.index("Join LeftOuter, (read_id")]


def test_strict_pileup(spark, intervals):
    a = spark.createDataFrame([(0, "r", 9, "c0", 9, 0, 4, 30, 34, False, ":4+ac")], SCHEMA).withColumn("mutations", C.mutations(F.col("cs"), F.col("contig_start")))
    b = a.withColumn("cs", F.lit(":1+a*ac:2")).withColumn("mutations", C.mutations(F.col("cs"), F.col("contig_start")))
    iv = intervals.where("interval_id = 0")
    assert pileup_query(b, iv, 4, "mutated").count() == 2
    assert pileup_query(a, iv, 4, "covered").count() == 4
    with pytest.raises(Exception, match="more variants"):
        pileup_query(b, iv, 4, "mutated", strict=True).collect()


def test_store_tables(store, rows, spark):
    info = store.info().first()
    assert info["alignments"] == len(rows) and info["reads"] == len({r["read_id"] for r in rows})
    assert info["mutations"] == sum(len(r["muts"]) for r in rows)
    assert store.mutation_dictionary().count() == len({(r["contig_id"], *m) for r in rows for m in r["muts"]})
    seen = list(dict.fromkeys(r["contig_id"] for r in rows))
    assert [r["contig_id"] for r in store.contigs.orderBy("contig_index").collect()] == seen
    with pytest.warns(UserWarning):
        got = store.by_read_ids(spark.createDataFrame([(rows[0]["read_id"],), (rows[0]["read_id"],), ("none",)], "read_id string"))
        assert got.count() == sum(r["read_id"] == rows[0]["read_id"] for r in rows)


def test_a_read_of_many_mutations(spark):
    """20,000 mutations in one read, there and back, and applied."""
    rng = random.Random(4)
    ref, ops, made, want = [], [], [], []
    for _ in range(20_000):
        gap = "".join(rng.choice("acgt") for _ in range(rng.randrange(1, 9)))
        ref.append(gap), made.append(gap), ops.append(f":{len(gap)}")
        at = sum(map(len, ref[-1:])) + (want[-1][3] if want else 0)
        kind, a, b = rng.choice("*+-"), rng.choice("ac"), rng.choice("gt")
        ops.append("*" + a + b if kind == "*" else kind + a + b)
        if kind == "*":
            ref.append(a), made.append(b), want.append(("SUB", at, (b + a).upper(), at + 1))
        elif kind == "+":
            made.append(a + b), want.append(("INS", at, (a + b).upper(), at))
        else:
            ref.append(a + b), want.append(("DEL", at, (a + b).upper(), at + 2))
    cs, reference = "".join(ops), "".join(ref).upper()
    df = spark.createDataFrame([(cs, 100, 100 + len(reference), reference)], "cs string, contig_start long, contig_end long, reference string")
    df = df.withColumn("m", C.mutations(F.col("cs"), F.col("contig_start")))
    r = df.select("m", C.regenerate(F.col("m"), F.col("contig_start"), F.col("contig_end")).alias("cs"), apply_mutations(F.col("reference"), F.col("m"), F.col("contig_start")).alias("made")).first()
    assert [(m["type"], m["position"] - 100, m["nts"]) for m in r["m"]] == [w[:3] for w in want]
    assert r["cs"] == cs and r["made"]["ok"] and r["made"]["sequence"] == "".join(made).upper()


def test_hot_contig(spark):
    """Many intervals of one contig: dealt over buckets, broadcast or not, and held against all pairs."""
    rng = random.Random(6)
    a = [(i, f"r{i}", 9, "c", 9, 0, 5, s := rng.randrange(400_000), s + rng.randrange(1, 3000), False, ":5") for i in range(300)]
    iv = [(k, "c", s := rng.randrange(400_000), s + rng.randrange(4000)) for k in range(200)]
    rows, intervals = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(iv, "interval_id long, contig_id string, start long, end long")
    longest = max(r[8] - r[7] for r in a)
    want = Counter((r[0], k) for r in a for k, _, s, e in iv if r[7] <= e and (r[8] > s or (r[8] == s and r[8] - r[7] < longest)))
    for how in (None, False):
        assert Counter((r["line_no"], r["interval_id"]) for r in interval_hits(rows, intervals, longest, broadcast=how).collect()) == want
    got = {(r["contig"], r["position"]): r["coverage"] for r in pileup_query(rows, intervals, longest, "covered").collect()}
    weight = Counter(k[0] for k in want.elements())
    inside = {p for _, _, s, e in iv for p in range(s, e)}
    cover = Counter()
    for r in a:
        for p in range(r[7], r[8]):
            if weight[r[0]] and p in inside:
                cover["c", p + 1] += weight[r[0]]
    assert got == dict(cover)
