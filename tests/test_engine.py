"""The hand-worked fixture: eight reads on one contig."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from readqc_spark.operators import intervals as iv
from readqc_spark.operators import pileup
from readqc_spark.plans.api import Intervals, analyze, bin_spec, main
from readqc_spark.sources import sinks, text

CONTIG = "ACGTTTACGGGNACGTAAACGTAC"
SCHEMA = "aln_id long, read_name string, flags int, chr string, pos int, mapq int, cigar string, seq string, quals array<int>, ec float, np int, rq float"
READS = [("r1", 0, 1, 60, "6M", "ACGTTT", [30] * 6, 10), ("r2", 0, 1, 60, "3M1I3M2D3M", "ACGTTTTGGG", [20] * 10, 5), ("r3", 16, 4, 40, "2S3=1X2D4M", "GGTTTCGGNA", [10, 10, 30, 30, 30, 2, 25, 25, 25, 25], 7), ("r4", 0, 8, 0, "2M4N3M1I2M", "CGACGGTA", [40] * 8, 3), ("r5", 2048, 13, 60, "4M4H", "ACGT", [30] * 4, 4), ("r6", 256, 13, 60, "4M", "ACGT", [30] * 4, 4), ("r7", 4, 0, None, "*", "ACGT", [30] * 4, 4), ("r8", 0, 2, None, "5S", "ACGTA", [20] * 5, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    contigs = spark.createDataFrame([("c1", CONTIG, len(CONTIG))], "chr string, seq string, length int")
    rows = [(i, n, f, "c1", p, q, c, s, qs, 12.34, k, 0.999123) for i, (n, f, p, q, c, s, qs, k) in enumerate(READS, 1)]
    return spark.createDataFrame(rows, SCHEMA), contigs


def test_alignments_and_summaries(tables):
    out = analyze(*tables, Intervals(homopolymers=True, windows=[4]), ["q_len:4"])
    got = {r["read_name"]: r for r in out["per_aln"].collect()}
    assert sorted(got) == ["r1", "r2", "r3", "r4", "r5", "r8"]
    keys = ("read_len", "mean_qual", "matches", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del")
    expect = {"r1": (6, 30, 6, 0, 0, 0, 0, 0), "r2": (11, 20, 9, 0, 0, 2, 1, 0), "r3": (10, 11, 7, 1, 0, 1, 0, 1), "r4": (7, 40, 3, 4, 1, 0, 0, 0), "r5": (4, 30, 4, 0, 0, 0, 0, 0), "r8": (0, 20, 0, 0, 0, 0, 0, 0)}
    for name, values in expect.items():
        assert tuple(got[name][k] for k in keys) == values, name
    assert round(got["r2"]["concordance_qv"], 2) == 6.02 and got["r8"]["mapq"] == 255 and math.isnan(got["r8"]["concordance"]) and got["r8"]["concordance_qv"] == 75
    i = out["identity"].first()
    assert (i["total_alns"], i["primary_alns"], round(i["identity"], 6), round(i["identity_qv"], 6), round(i["gap_compressed_identity"], 6)) == (8, 5, 0.694444, 5.149098, 0.735294)
    assert [(r[0], r[1], r[2]) for r in out["yield"].collect()][:4] == [(0, 5, 39), (5, 4, 31), (10, 2, 11), (15, 2, 11)]
    assert [(r["cigar"], r["length"], r["count"]) for r in out["cigar"].collect()] == [("=", 3, 1), ("D", 2, 2), ("I", 1, 2), ("M", 2, 2), ("M", 3, 4), ("M", 4, 1), ("M", 6, 1), ("X", 1, 1)]
    assert {r["qual_score"]: round(r["empirical_qv"], 2) for r in out["qual_score"].filter("feature = 'all_alignments'").collect()} == {2: 0.0, 20: 75.0, 25: 75.0, 30: 75.0, 40: 2.43}
    f = {r["feature"]: r for r in out["feature"].collect()}
    assert f["window_4"]["intervals"] == 11 and round(f["window_4"]["identical_intervals"], 6) == 0.545455 and round(f["window_4"]["mean_qual"], 6) == 16.059534
    assert {k: r["intervals"] for k, r in f.items() if k != "window_4"} == {"2A": 1, "3A": 1, "3C": 1, "3G": 2, "3T": 2}
    assert [(r["bin"], r["num_reads"], r["num_bases"], round(r["identity_qv"], 6)) for r in out["bin"].collect()] == [(4.0, 2, 6, 75.0), (8.0, 3, 28, 4.357286)]


@pytest.mark.parametrize("pos, cigar, seq, want", [(1, "3M1I3M", "ACGGTTT", ("non_hp_ins", 1)), (1, "6M1I3M", "ACGTTTCACG", ("hp_ins", 1)), (1, "3M2I3M", "ACGTATTT", ("non_hp_ins", 2)), (1, "8M2D4M", "ACGTTTACGNAC", ("hp_del", 2)), (1, "1X", "A", ("mismatches", 1)), (12, "1M", "N", ("matches", 1))])
def test_semantics(spark, tables, pos, cigar, seq, want):
    one = spark.createDataFrame([(1, "x", 0, "c1", pos, 60, cigar, seq, [30] * len(seq), None, None, None)], SCHEMA)
    assert analyze(one, tables[1])["per_aln"].first()[want[0]] == want[1]


def test_reverse_windows_and_borders(spark, tables):
    one = spark.createDataFrame([(1, "x", 16, "c1", 4, 60, "10M", "T" * 10, [30] * 10, None, None, None)], SCHEMA)
    rows = pileup.with_contig(one, tables[1])
    assert [(r.start, r.stop) for r in iv.generated(rows, [iv.windows(4)]).collect()] == [(10, 14), (6, 10), (4, 6)]
    assert [(r.start, r.stop) for r in iv.generated(rows, [iv.borders(4)]).collect()] == [(8, 12), (4, 8)]


def test_rejections(spark, tables):
    for flags_chr_cigar in ((0, "c9", "1M"), (0, "c1", "1P"),):
        one = spark.createDataFrame([(1, "x", flags_chr_cigar[0], flags_chr_cigar[1], 1, 60, flags_chr_cigar[2], "A", [30], None, None, None)], SCHEMA)
        with pytest.raises(Exception, match="no such contig|operation that isn"):
            analyze(one, tables[1])["per_aln"].collect()
    for bad in ("q_len", "size:3", "q_len:0"):
        with pytest.raises(ValueError):
            bin_spec(bad)


def test_text_sources_and_command_line(spark, tmp_path):
    (tmp_path / "r.fa").write_text(f">c1 a > b\n{CONTIG[:10].lower()}\n{CONTIG[10:]}\n>c2\nAC\n")
    sam = "@HD\tVN:1.6\n" + "".join(f"{n}\t{f}\t{'*' if f & 4 else 'c1'}\t{p}\t{255 if q is None else q}\t{c}\t*\t0\t0\t{s}\t{''.join(chr(33 + x) for x in qs)}\tnp:i:{k}\tec:f:12.34\trq:f:0.999123\n" for n, f, p, q, c, s, qs, k in READS)
    (tmp_path / "r.sam").write_text(sam)
    (tmp_path / "r.bed").write_text("c1\t0\t5\nc1\t2\t9\tx\textra\n")
    assert [tuple(r) for r in text.bed(spark, str(tmp_path / "r.bed")).collect()] == [("c1", 1, 6, "none"), ("c1", 3, 10, "x")]
    main([str(tmp_path / "r.sam"), str(tmp_path / "r.fa"), str(tmp_path / "out"), "-n", "s1", "--intervals-bed", str(tmp_path / "r.bed"), "--bin-types", "q_len:4"])
    assert (tmp_path / "out.summary_identity_stats.csv").read_text().split("\n")[1].startswith("s1,8,5,0.694444,5.149098,0.735294,735.294118")
    lines = gzip.open(tmp_path / "out.per_aln_stats.csv.gz", "rt").read().split("\n")
    assert lines[0].split(",")[1:] == sinks.PER_ALN and any(x.startswith("s1,r1,c1,1,6,12,10,0.9991,primary,+,60,30,6,0.250000,0.333333,1.000000,1.000000,75.00,0") for x in lines)


def test_number_text():
    assert [sinks.number(x, "a") for x in (0.125, float("nan"), None, 3)] == ["0.125000", "NaN", "", "3"] and sinks.number(-0.0, "empirical_qv") == "-0.00"
