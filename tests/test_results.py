"""Long reads, large contigs, split files, and every file that the command line writes."""

import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readqc_spark.operators import aln_stats, pileup, summaries
from readqc_spark.operators import intervals as iv
from readqc_spark.plans import files, queries, simulated
from readqc_spark.plans.api import Intervals, analyze, main
from readqc_spark.sources import bam, sinks, text
from readqc_spark.streaming import incremental
from test_engine import CONTIG, READS, SCHEMA


@pytest.fixture(scope="module")
def genome(spark):
    r = random.Random(1)
    seqs = {f"c{k}": "".join(r.choice("ACGT") for _ in range(n)) for k, n in enumerate((3000, 900, 1))}
    rows = []
    for i in range(300):
        c = r.choice(["c0", "c0", "c1"])
        ops, span, size = [], 0, 0
        for _ in range(r.randrange(1, 40)):
            op, n = r.choice("MMMX=IDNSH"), r.randrange(0, 12 if r.random() < 0.9 else 60)
            ops.append(f"{n}{op}")
            span += n * (op in "MX=DN")
            size += n * (op in "MX=IS")
        seq = "".join(r.choice("ACGT") for _ in range(size + 1))
        pos = len(seqs[c]) - span + 1 if i % 9 == 0 and span < 900 else r.randrange(1, max(2, len(seqs[c]) - span))
        rows.append((i, f"r{i}", r.choice([0, 16, 2048, 256]), c, max(pos, 1), 60, "".join(ops) + "1S", seq, [r.randrange(0, 60) for _ in seq], None, 3, None))
    contigs = spark.createDataFrame([(k, v, len(v)) for k, v in seqs.items()], "chr string, seq string, length int")
    return spark.createDataFrame(rows, SCHEMA).cache(), contigs.cache()


def test_a_read_of_many_operations(spark):
    n = 100_000
    contig = spark.createDataFrame([("c", "ACGT" * (n // 4), n)], "chr string, seq string, length int")
    one = spark.createDataFrame([(1, "x", 0, "c", 1, 60, "1=1X" * (n // 2), "ACGT" * (n // 4), [30] * n, None, None, None)], SCHEMA)
    out = analyze(one, contig, Intervals(homopolymers=True, windows=[1000]))
    r = out["per_aln"].first()
    assert (r["matches"], r["mismatches"], r["read_len"]) == (n // 2, n // 2, n)
    assert [(x["cigar"], x["length"], x["count"]) for x in out["cigar"].collect()] == [("=", 1, n // 2), ("X", 1, n // 2)]
    assert out["feature"].first()["intervals"] == n // 1000
    with pytest.raises(Exception, match="operation that isn"):
        analyze(one.withColumn("cigar", F.concat("cigar", F.lit("1P"))), contig)["per_aln"].collect()


def test_tiles(spark, genome, monkeypatch):
    alns, contigs = genome
    whole = pileup.with_contig(alns, contigs, 0).select("aln_id", "ref", "contig_length")
    monkeypatch.setattr(pileup, "TILE", 64)
    monkeypatch.setattr(pileup, "OVERLAP", 40)
    assert sorted(pileup.with_contig(alns, contigs).select("aln_id", "ref", "contig_length").collect()) == sorted(whole.collect())


def test_contigs_joined_whole(spark, genome, monkeypatch):
    """Contigs above the broadcast and up to a tile: no broadcast, and each table is scanned once."""
    alns, contigs = genome
    whole = pileup.with_contig(alns, contigs, 0).select("aln_id", "ref", "contig_length")
    monkeypatch.setattr(pileup, "BROADCAST_BASES", 1000)
    joined = pileup.with_contig(alns, contigs, 3901, 3000).select("aln_id", "ref", "contig_length")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(joined.collect()) == sorted(whole.collect())
    assert plan.count("InMemoryRelation") == 2 and "strategy=broadcast" not in plan


def test_bases_by_a_table_of_bytes(spark, monkeypatch):
    """As lower-casing, taking out and translating by Spark's functions give them, for every character and for slices of any size."""
    texts = ["".join(chr(k) for k in range(a, a + 4096) if not 0xD800 <= k < 0xE000) for a in range(0, 0x110000, 4096)] + ["", "İK aZ\u212a", None, "ÅßΣς ABC xyz", "z" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [r[0] or "" for r in df.select(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), simulated.LETTERS, simulated.BASES)).collect()]
    for size in (1 << 20, 7):
        monkeypatch.setattr(simulated, "_AT_ONCE", size)
        assert simulated._bases(pa.array(texts)).to_pylist() == want
        assert simulated._bases(pa.array(texts).slice(3, 270)).to_pylist() == want[3:273]
    assert simulated._bases(pa.array([], pa.string())).to_pylist() == []
    seqs = {r["seq"] for r in simulated.contigs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), simulated.LETTERS, simulated.BASES).alias("s"))
    assert seqs == {r[0] for r in docs.filter(F.length("s") >= simulated.SHORTEST).collect()}
    assert "regexp_replace" not in simulated.contigs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_broadcast_query_is_bounded(spark, monkeypatch):
    """Contigs above the bound aren't broadcast by the query either."""
    d = "/root/testdata/sf0.001"
    query = lambda: queries.QUERIES["join_contig_broadcast"](spark, d)
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    small = query()
    assert hinted(small)
    monkeypatch.setattr(pileup, "BROADCAST_BASES", 1000)
    large = query()
    assert not hinted(large) and sorted(large.collect()) == sorted(small.collect())


def test_intervals_against_events(spark, genome, monkeypatch):
    alns, contigs = genome
    r = random.Random(3)
    bed = spark.createDataFrame([("c0", (a := r.randrange(1, 2900)), a + r.randrange(0, 90), r.choice(["x", "y", "none"])) for _ in range(150)] + [("c9", 1, 5, "x")], "chr string, start int, stop int, feature string")
    rows = pileup.with_contig(pileup.mapped_primary(alns), contigs, 0)
    events = [e.asDict() for e in pileup.events(rows).collect()]
    kinds = [iv.homopolymers(), iv.windows(7), iv.windows(50, True), iv.borders(9), iv.matches("ac")]
    made = [tuple(x) for x in iv.generated(rows, kinds).collect()] + [tuple(x) for x in iv.bed_overlap(rows, bed).collect()]
    want: dict = {}
    hists: dict = {}
    mine: dict = {}
    for e in events:
        mine.setdefault(e["aln_id"], []).append(e)
    names = {("match", False): 2, ("mismatch", False): 3, ("ins", False): 4, ("del", False): 5, ("ins", True): 6, ("del", True): 7}
    for a, start, stop, key in made:
        w = want.setdefault(key, [0] * 8)
        held = [e for e in mine.get(a, []) if start <= e["ref_pos"] < stop]
        w[0] += 1
        w[1] += all(e["kind"] == "match" for e in held)
        for e in held:
            w[names[e["kind"], e["hp"]]] += e["n"]
            if e["kind"] in ("match", "mismatch"):
                hists.setdefault((key, e["qual"]), [0, 0])[e["kind"] == "mismatch"] += 1
    for most, at_once in ((1000, 1 << 20), (10, 50)):
        monkeypatch.setattr(iv, "BROADCAST_BED", most)
        monkeypatch.setattr(iv, "AT_ONCE", at_once)
        carried, beds = iv.with_beds(rows, [bed])
        sums = iv.attributed(carried, kinds + beds, everything=False).groupBy("feature_key", "hist", "qual").agg(*[F.sum(c).alias(c) for c in ("intervals", "identical", *iv.COUNTS)]).collect()
        assert {x["feature_key"]: list(x[3:]) for x in sums if not x["hist"]} == want
        assert {(x["feature_key"], x["qual"]): [x["matches"], x["mismatches"]] for x in sums if x["hist"]} == hists


def test_large_bed_is_joined_by_place(spark, genome, monkeypatch):
    """A table above the broadcast: what a read overlaps is found without its contig, and no limit brings the table to one task."""
    alns, contigs = genome
    bed = spark.createDataFrame([("c0", a, a + 30, f"f{a % 3}") for a in range(1, 2900, 17)], "chr string, start int, stop int, feature string").cache()
    mapped = pileup.mapped_primary(alns)
    rows = pileup.with_contig(mapped, contigs, 0)
    sums = lambda r, kinds: sorted(iv.stabbed(r, kinds).collect())
    want = sums(*iv.with_beds(rows, [bed]))
    monkeypatch.setattr(iv, "BROADCAST_BED", 10)
    monkeypatch.setattr(type(bed), "limit", lambda self, n: pytest.fail("a limit"))
    carried, kinds = iv.with_beds(rows, [bed], pileup.placed(mapped))
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert sums(carried, kinds) == want and plan.count("strategy=broadcast") == 1


def test_overlap_query_needs_no_contig(spark):
    """Contigs are derived twice, for the reads and for the BED table, and not a third time for bases."""
    plan = queries.QUERIES["intervals_bed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_bases(text") == 2


def test_union_gathers_nothing(spark):
    d = "/root/testdata/sf0.001"
    rows, kinds = queries.with_kinds(spark, d, queries.rows(spark, d))
    assert sorted(queries.all_intervals(spark, d).collect()) == sorted(iv.generated(rows, kinds).collect())
    assert "collect_list" not in queries.all_intervals(spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_events_of_a_kind(spark, genome):
    """Only what is asked for leaves the walk."""
    rows = pileup.with_contig(pileup.mapped_primary(genome[0]), genome[1], 0)
    every = pileup.events(rows)
    for kinds in (("del",), ("match", "mismatch"), ("ins",)):
        assert sorted(pileup.events(rows, kinds).collect(), key=str) == sorted(every.filter(F.col("kind").isin(*kinds)).collect(), key=str)


def test_one_pass_against_single_ones(spark, genome):
    alns, contigs = genome
    skipped = spark.createDataFrame([(1000, "u", 4, None, 0, None, "*", "", [], None, None, None), (1001, "s", 256, "nowhere", 1, 3, "1P", "A", [1], None, None, None)], SCHEMA)
    out = analyze(alns.unionByName(skipped), contigs, Intervals(windows=[7]), ["mapq:7"])
    rows = pileup.with_contig(pileup.mapped_primary(alns), contigs, 0)
    stats = aln_stats.stats(rows)
    assert sorted(map(str, out["per_aln"].collect())) == sorted(map(str, stats.collect()))
    main_ = rows.filter(~pileup.flag(pileup.SUPPLEMENTARY))
    assert out["cigar"].collect() == summaries.cigars(main_).collect()
    assert str(out["qual_score"].collect()) == str(summaries.qual_scores(iv.attributed(main_, [iv.windows(7)])).collect())
    assert out["identity"].first()["total_alns"] == 302


def test_no_bases(spark, genome):
    for seq, quals in (("", []), ("*", [1]), ("A", [])):
        one = spark.createDataFrame([(1, "x", 0, "c0", 1, 60, "1M", seq, quals, None, None, None)], SCHEMA)
        with pytest.raises(Exception, match="without bases or without qualities"):
            analyze(one, genome[1])["per_aln"].collect()


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_bam_in_splits(spark, genome, tmp_path, monkeypatch, split):
    alns, contigs = genome
    rows = [r.asDict() for r in alns.orderBy("aln_id").collect()]
    want = [(r["read_name"], r["flags"], r["chr"], r["pos"], r["cigar"], r["seq"], r["quals"], r["np"]) for r in rows]
    for k, part in enumerate((rows[:150], rows[150:], [])):
        (tmp_path / f"{k}.bam").write_bytes(b"".join(files.bam_bytes(iter(part), [("c0", 3000), ("c1", 900), ("c2", 1)], size=1000)))
    got = bam.bam(spark, str(tmp_path), split)
    shown = lambda df: sorted((r["read_name"], r["flags"], r["chr"], r["pos"], r["cigar"], r["seq"], r["quals"], r["np"]) for r in df.collect())
    assert shown(got) == sorted(want) and got.select("aln_id").distinct().count() == 300
    if split == 5000:
        whole = spark.read.format("binaryFile").load(str(tmp_path)).select("content").mapInArrow(bam._whole, bam.SCHEMA)
        assert shown(whole) == sorted(want)


def test_bam_of_many_references(spark, genome, tmp_path, monkeypatch):
    """A header of many blocks: its bytes are gone through once, no split is looked for in it, and tasks don't grow in number with small splits."""
    rows = [r.asDict() for r in genome[0].orderBy("aln_id").limit(50).collect()]
    names = [(f"c{k}", 3000) for k in range(40_000)]
    data = b"".join(files.bam_bytes(iter(rows), names, size=1000))
    (tmp_path / "x.bam").write_bytes(data)
    heads = []
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, shape, f=spark.createDataFrame: (heads.append(len(rows)), f(rows, shape))[1])
    got = bam.bam(spark, str(tmp_path), 700)
    assert sorted((r["read_name"], r["chr"], r["seq"]) for r in got.collect()) == sorted((r["read_name"], r["chr"], r["seq"]) for r in rows)
    assert max(heads) * 700 < len(data) / 2 and got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_wrong_guesses_are_replaced(spark, genome):
    """Names that look like records don't mislead: what a guess gives is held against where the split before ends."""
    alns, _ = genome
    rows = [r.asDict() for r in alns.orderBy("aln_id").limit(60).collect()]
    data = b"".join(files.bam_bytes(iter(rows), [("c0", 3000), ("c1", 900)], size=1000))
    file = bam._Held(data)
    b, at = bam._begun(file, len(data), 0, 0, None)
    ends = [b.place(p) for p in bam._walk(b, at, len(data) + 1) if p >= 0]
    for start in range(1, len(data), 997):
        b, at = bam._begun(file, len(data), start, 2, None)
        assert at == len(b.data) or b.place(at) in ends


def test_types_of_tags(spark, tmp_path):
    (tmp_path / "x.sam").write_text("r\t0\tc\t1\t9\t1M\t*\t0\t0\tA\tI\tnp:f:1.5\n")
    with pytest.raises(Exception, match="of another type"):
        text.sam(spark, str(tmp_path / "x.sam")).collect()
    row = {"read_name": "r", "flags": 0, "chr": "c", "pos": 1, "mapq": None, "cigar": "1M", "seq": "A", "quals": [3], "ec": 1.5, "np": 2, "rq": None}
    good = files.record(row, {"c": 0})
    assert bam.record(good, 0, ["c"])[0][-3:] == (1.5, 2, None)
    with pytest.raises(ValueError, match="of another type"):
        bam.record(good.replace(b"npC\x02", b"npA\x02"), 0, ["c"])


def test_cigar_in_a_tag():
    row = {"read_name": "r", "flags": 0, "chr": "c", "pos": 1, "mapq": 9, "seq": "ACGT" * 20_000, "quals": [3] * 80_000, "ec": None, "np": 2, "rq": None}
    for cigar in ("1M1I" * 40_000, "80000S5N", "1=" * 65_535 + "14465S"):
        data = files.record(row | {"cigar": cigar}, {"c": 0})
        got, end = bam.record(data, 0, ["c"])
        assert got[5] == cigar and got[6] == row["seq"] and got[9] == 2 and end == len(data)


def test_gzip_fasta_and_repeated_names(spark, tmp_path):
    for name, opened in (("a.fa", open), ("b.fa.gz", gzip.open)):
        with opened(tmp_path / name, "wt") as f:
            f.write(">c1 first\nACGT\n>c2\nNN\nac\n>c1 last\nTT\n\nGG\n")
        assert sorted(tuple(r) for r in text.fasta(spark, str(tmp_path / name)).collect()) == [("c1", "TTGG", 4), ("c2", "NNAC", 4)]


def test_every_file_of_the_command_line(spark, tmp_path):
    (tmp_path / "r.fa").write_text(f">c1\n{CONTIG}\n")
    rows = [{"read_name": n, "flags": f, "chr": None if f & 4 else "c1", "pos": p, "mapq": q, "cigar": c, "seq": s, "quals": qs, "np": k, "ec": 12.34, "rq": 0.999123} for n, f, p, q, c, s, qs, k in READS]
    (tmp_path / "r.bam").write_bytes(b"".join(files.bam_bytes(iter(rows), [("c1", len(CONTIG))])))
    main([str(tmp_path / "r.bam"), str(tmp_path / "r.fa"), str(tmp_path / "o"), "--intervals-window", "4", "--bin-types", "q_len:4", "gc_content:0.25", "q_len:1000000"])
    read = lambda name: (tmp_path / f"o.summary_{name}_stats.csv").read_text().split("\n")
    assert read("identity")[1].startswith("8,5,0.694444,5.149098,0.735294,735.294118")
    assert read("yield")[1:5] == ["0,5,39", "5,4,31", "10,2,11", "15,2,11"] and len(read("yield")) == 17
    assert read("cigar")[1:4] == ["=,3,1,1.000000", "D,2,2,1.000000", "I,1,2,1.000000"]
    bins = read("bin")
    assert bins[1].startswith("q_len:4,4,2,6,1.000000,75.000000") and bins[2].startswith("q_len:4,8,3,28,0.633333,4.357286")
    assert [x.split(",")[:2] for x in bins[3:-1]] == [["gc_content:0.25", "0.250000"], ["gc_content:0.25", "0.500000"], ["gc_content:0.25", "NaN"], ["q_len:1000000", "0"]]
    assert read("qual_score")[1:6] == ["all_alignments,2,-0.00", "all_alignments,20,75.00", "all_alignments,25,75.00", "all_alignments,30,75.00", "all_alignments,40,2.43"]
    assert read("feature")[1].startswith("window_4,11,0.545455,0.694444,5.149098,16.059534,3.090909")
    lines = gzip.open(tmp_path / "o.per_aln_stats.csv.gz", "rt").read().split("\n")
    assert lines[0].split(",") == sinks.PER_ALN and len(lines) == 8 and not (tmp_path / "o.per_aln_stats.csv.gz.parts").exists()
    assert any(x.startswith("r8,c1,2,5,12,1,0.9991,primary,+,255,20,0,0.000000,NaN,NaN,NaN,75.00,0") for x in lines)


def test_texts_of_numbers():
    assert [summaries.bin_text(*x) for x in (("q_len", 1000000), ("q_len", 1234567), ("gc_content", 0.05), ("concordance_qv", 1.0), ("gc_content", 1e-7))] == ["q_len:1000000", "q_len:1234567", "gc_content:0.05", "concordance_qv:1", "gc_content:0.0000001"]
    assert sinks.number(0.125, "effective_coverage") == "0.12" and sinks.number(12.34, "effective_coverage", True) == "12" and sinks.number(5.25, "effective_coverage", True) == "5."
    assert sinks.bin_number(8.0, "mapq:8") == "8" and sinks.bin_number(1.5, "concordance_qv:0.5") == "1.50"


def test_stream(spark, genome, tmp_path):
    alns, contigs = genome
    source = str(tmp_path / "in")
    alns.filter("aln_id < 100").write.parquet(source)
    alns.filter("aln_id >= 100").write.mode("append").parquet(source)
    stream = spark.readStream.schema(alns.schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = incremental.start(stream, contigs, str(tmp_path / "state"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert incremental.merged(spark, str(tmp_path / "state")).collect() == incremental.batch_state(alns, contigs).collect()


def test_mean_quals():
    lists = pa.array([[30] * 4, [], None, [2, 40], [0, 255]], pa.list_(pa.int32()))
    from readqc_spark.functions.numeric import mean_quals

    assert mean_quals(lists).tolist() == [30, 0, 0, 5, 3] and mean_quals(lists.slice(3)).tolist() == [5, 3]
