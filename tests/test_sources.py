import io
import random

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.functions.sequences import first_mismatch, reverse_complement
from readloom.operators.store import AlignmentStore
from readloom.sources import binary, sequences, store_file
from readloom.sources.intervals import intervals_from, read_intervals
from readloom.sources.paf import parse_lines
from readloom.sources.simulate import simulate_paf
from readloom.streaming.paf_stream import stream_alignments, stream_bins


def written(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines))
    return str(path)


def line(cs=":10", start=0, end=10, read="r1", strand="+", tags=("NM:i:0",)):
    return "\t".join([read, "10", "0", "10", strand, "c", "100", str(start), str(end), "10", "10", "60", *tags, f"cs:Z:{cs}"])


def test_paf(spark, tmp_path):
    p = written(tmp_path / "a.paf", line(), line("*ac:9", 5, 15, "r2", "-"), line(":10", 1, 11, "r3"))
    store = AlignmentStore.from_paf(spark, p, max_reads=2)
    rows = store.alignments.orderBy("line_no").collect()
    assert [(r["line_no"], r["read_id"], r["is_reverse"]) for r in rows] == [(0, "r1", False), (1, "r2", True)]
    assert [tuple(m) for m in rows[1]["mutations"]] == [("SUB", 5, "CA")]


@pytest.mark.parametrize("bad", ["a\tb", line(":9"), line(":10", 10, 10), line(":5:5"), line("=acgtacgtac")])
def test_bad_lines(spark, tmp_path, bad):
    with pytest.raises(Exception):
        AlignmentStore.from_paf(spark, written(tmp_path / "b.paf", bad)).alignments.collect()


def test_dropped_lines(spark, tmp_path):
    p = written(tmp_path / "b.paf", line(), line(":9"))
    assert AlignmentStore.from_paf(spark, p, on_bad_cs="drop").alignments.count() == 1


def test_intervals(spark, tmp_path):
    assert [tuple(r) for r in read_intervals(spark, written(tmp_path / "i.txt", "contig\tstart\tend", "c 1 5", "d\t2\t3")).collect()] == [(0, "c", 1, 5), (1, "d", 2, 3)]
    assert read_intervals(spark, written(tmp_path / "e.txt")).count() == 0
    with pytest.raises(ValueError):
        read_intervals(spark, written(tmp_path / "h.txt", "contig start end", "c 1 5"))
    with pytest.raises(Exception):
        read_intervals(spark, written(tmp_path / "m.txt", "contig\tstart\tend", "c 1")).collect()
    df = spark.createDataFrame([("c", 1, 5)], "contig string, start long, end long")
    assert tuple(intervals_from(df).first())[1:] == ("c", 0, 5)
    for wrong in (df.where("false"), df.withColumn("start", F.lit(0)), df.drop("end")):
        with pytest.raises(ValueError):
            intervals_from(wrong)


def test_sequences(spark, tmp_path):
    fa = written(tmp_path / "c.fa", ">c one", "ACGT", "AC", ">d", "GG")
    fq = written(tmp_path / "r.fq", "@r1 x", "ACG", "+", "III", "@r2", "TT", "+", "II")
    assert sorted(map(tuple, sequences.read_sequences(spark, fa).collect())) == [("c", "ACGTAC"), ("d", "GG")]
    assert sorted(map(tuple, sequences.read_sequences(spark, fq).collect())) == [("r1 x", "ACG"), ("r2", "TT")]
    odd = written(tmp_path / "o.fa", ">c1 map a->b", "AC", "GT", ">c2", "G>T", "", ">c3")
    assert sorted(map(tuple, sequences.read_fasta(spark, odd).collect())) == [("c1", "ACGT"), ("c2", "G>T"), ("c3", "")]
    dos = tmp_path / "d.fa"
    dos.write_bytes(b">c one\r\nACGT\r\n>d\r\nGG\r\n")
    assert sorted(map(tuple, sequences.read_fasta(spark, str(dos)).collect())) == [("c", "ACGT"), ("d", "GG")]
    only = spark.createDataFrame([("d",)], "id string")
    assert sequences.read_fasta(spark, fa, only).count() == 1
    with pytest.raises(ValueError):
        sequences.read_sequences(spark, written(tmp_path / "x", "zzz"))
    sequences.write_fastq(sequences.read_fasta(spark, fa), str(tmp_path / "out.fq"))
    assert sorted(map(tuple, sequences.read_fastq(spark, str(tmp_path / "out.fq")).collect())) == [("c", "ACGTAC"), ("d", "GG")]
    df = spark.createDataFrame([("ACgNT", "ACGNT")], "a string, b string")
    assert tuple(df.select(reverse_complement(F.col("a")), first_mismatch(F.col("a"), F.col("b"))).first()) == ("ANgGT", 2)


def test_simulated_lines_are_valid(spark):
    lines = simulate_paf(spark, 200, seed=3)
    assert parse_lines(lines).count() == 200
    assert sorted(lines.collect()) == sorted(simulate_paf(spark, 200, seed=3).collect())


def test_binary_store(spark):
    rows = [(0, "r", 9, "c", 99, 0, 5, 3, 8, True, [("SUB", 4, "AC"), ("INS", 5, "G")]), (1, "s", 9, "c", 99, 0, 5, 3, 8, False, [("SUB", 4, "AC")])]
    f = io.BytesIO()
    binary.write_store(f, rows)
    f.seek(0)
    assert list(binary.read_store(f)) == rows
    with pytest.raises(ValueError):
        list(binary.read_store(io.BytesIO(b"nothing")))


def test_store_file_from_and_to_dataframes(spark, tmp_path):
    paf = written(tmp_path / "a.paf", line(), line("*ac:9", 5, 15, "r2", "-"), line(":3+ac:2-gt:3", 20, 30, "r1").replace("\tc\t", "\td\t"), line("*ac:9", 5, 15, "r3"))
    store = AlignmentStore.from_paf(spark, paf)
    store_file.save_store_file(store, str(tmp_path / "a.aln"))
    rows = [(r["line_no"], r["read_id"], r["read_length"], r["contig_id"], r["contig_length"], r["read_start"], r["read_end"], r["contig_start"], r["contig_end"], r["is_reverse"], [tuple(m) for m in r["mutations"]]) for r in store.alignments.collect()]
    want = io.BytesIO()
    binary.write_store(want, rows)
    assert (tmp_path / "a.aln").read_bytes() == want.getvalue()
    back = store_file.load_store_file(spark, str(tmp_path / "a.aln"))
    assert sorted(back.alignments.collect()) == sorted(store.alignments.select(*back.alignments.columns).collect())


def test_commands(spark, tmp_path, capsys):
    rng = random.Random(1)
    contig = "".join(rng.choice("ACGT") for _ in range(100))
    other = "C" if contig[13] != "C" else "G"
    read = contig[10:13] + other + contig[14:20]
    back = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    paf = written(tmp_path / "a.paf", line(f":3*{contig[13].lower()}{other.lower()}:6", 10, 20), line(f":3*{contig[13].lower()}{other.lower()}:6", 10, 20, "r2", "-"))
    fa = written(tmp_path / "c.fa", ">c", contig)
    fq = written(tmp_path / "r.fq", "@r1", read, "+", "I" * 10, "@r2", back, "+", "I" * 10)
    iv = written(tmp_path / "i.txt", "contig\tstart\tend", "c\t0\t50")
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    assert cli.main(["construct", "-ifn_paf", paf, "-ofn", store, "-verify", "T", "-ifn_reads", fq, "-ifn_contigs", fa], spark) == 0
    assert cli.main(["info", "-ifn", store], spark) == 0
    assert cli.main(["extract", "-ifn", store, "-ofn_prefix", out], spark) == 0
    assert cli.main(["verify", "-ifn_aln", store, "-ifn_reads", fq, "-ifn_contigs", fa, "-ofn_contigs", f"{out}.fa"], spark) == 0
    assert "bad alignments: 0 of 2" in capsys.readouterr().out
    for mode in ("full", "pileup", "bin"):
        assert cli.main(["query", "-ifn_aln", store, "-ifn_intervals", iv, "-ofn_prefix", out, "-mode", mode], spark) == 0
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{out}_pileup.tsv").where("position = 14").collect()
    assert [(r["variant"], r["count"], r["coverage"]) for r in got] == [(f"{other}:{contig[13]}", "2", "2")]
    with pytest.raises(SystemExit):
        cli.main(["query", "-ifn_aln", store, "-ifn_intervals", iv, "-ofn_prefix", out, "-mode", "none"], spark)
    wrong = written(tmp_path / "w.fq", "@r1", contig[:10], "+", "I" * 10, "@r2", back, "+", "I" * 10)
    for quit_, n in ((True, 1), (False, 2)):
        both = written(tmp_path / "w2.fq", "@r1", contig[:10], "+", "I" * 10, "@r2", contig[:10], "+", "I" * 10)
        with pytest.raises(ValueError, match=f"found {n} bad"):
            AlignmentStore.build(spark, paf, str(tmp_path / "s2"), True, both, fa, quit_on_error=quit_)
    with pytest.raises(ValueError):
        AlignmentStore.build(spark, paf, str(tmp_path / "s2"), True, wrong, fa)


def test_command_output_is_single_files_in_store_order(spark, tmp_path):
    paf = written(tmp_path / "a.paf", *[line("*ac:9", 5, 15, f"r{9 - i}").replace("\tc\t", f"\tz{9 - i}\t") for i in range(6)])
    iv = written(tmp_path / "i.txt", "contig\tstart\tend", *[f"z{k}\t0\t20" for k in (4, 9, 7)])
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    cli.main(["construct", "-ifn_paf", paf, "-ofn", store], spark)
    cli.main(["extract", "-ifn", store, "-ofn_prefix", out], spark)
    rows = [x.split("\t") for x in open(f"{out}_alignments.txt").read().splitlines()]
    assert rows[0][0] == "read_id" and [r[0] for r in rows[1:]] == [f"r{9 - i}" for i in range(6)]
    assert len(open(f"{out}_mutations.txt").read().splitlines()) == 7
    cli.main(["query", "-ifn_aln", store, "-ifn_intervals", iv, "-ofn_prefix", out, "-mode", "bin", "-binsize", "10"], spark)
    rows = [x.split("\t") for x in open(f"{out}_bins.tsv").read().splitlines()]
    assert [r[0] for r in rows[1:]] == ["z9", "z9", "z7", "z7", "z4", "z4"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.paf", line(), line("*ac:9", 5, 15, "r2"))
    q = stream_bins(stream_alignments(spark, str(tmp_path / "in")), 10).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bins").collect())) == [("c", 0, 15, 1), ("c", 10, 5, 0)]


def test_first_mismatch_at_any_place(spark):
    """Against a walk, at lengths about powers of two, characters of several bytes too; the steps are as many as a length has binary digits."""
    texts = ["", "a", "b"]
    pairs = [(x, y) for x in texts for y in texts]
    for n in (1, 2, 3, 7, 8, 9, 31, 32, 33):
        whole = ("ac\u00e9g" * 9)[:n]
        pairs += [(whole, whole + "t"), (whole + "tt", whole), *((whole, whole[:k] + "x" + whole[k + 1 :]) for k in range(n))]
    walk = lambda a, b: None if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    made = first_mismatch(F.col("a"), F.col("b"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", made.alias("n")).collect()
    assert [r["n"] for r in got] == [walk(r["a"], r["b"]) for r in got]
    assert "sequence(1," not in made._jc.toString()
