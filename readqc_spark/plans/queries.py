"""The registered queries of the engine, over alignments derived from the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.functions import numeric as nm
from readqc_spark.operators import aln_stats, cigar, pileup, summaries
from readqc_spark.operators import intervals as iv
from readqc_spark.plans import files
from readqc_spark.plans import simulated as sim
from readqc_spark.sources import bam, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def contigs(spark, d):
    return sim.contigs(spark, d)


def alns(spark, d):
    return sim.alignments(contigs(spark, d))


def mapped(spark, d):
    return pileup.mapped_primary(alns(spark, d))


def bounds(spark, d):
    """(bases of all contigs, of the longest one) at most: contigs have a base for each letter of a text at most."""
    return tuple(n or 0 for n in spark.read.parquet(f"{d}/documents.parquet").agg(F.sum("n_chars"), F.max("n_chars")).first())


def rows(spark, d):
    """Reads with their slices."""
    return pileup.with_contig(mapped(spark, d), contigs(spark, d), *bounds(spark, d))


def primary_rows(spark, d):
    return rows(spark, d).filter(~pileup.flag(pileup.SUPPLEMENTARY))


def events(spark, d, *kinds):
    return pileup.events(rows(spark, d), kinds)


def stats(spark, d):
    return aln_stats.stats(rows(spark, d))


KINDS = (iv.homopolymers, lambda: iv.windows(20), lambda: iv.windows(25, True), lambda: iv.borders(15), lambda: iv.matches("acg"))


def with_kinds(spark, d, r):
    """(rows, all generators), the BED table among them."""
    r, beds = iv.with_beds(r, [sim.bed(contigs(spark, d))], pileup.placed(mapped(spark, d)))
    return r, [k() for k in KINDS] + beds


def all_intervals(spark, d):
    """Those of the BED table come from its join, so no read has to gather them."""
    return iv.generated(rows(spark, d), [k() for k in KINDS]).unionByName(join_bed_overlap(spark, d))


@query
def src_contigs(spark, d):
    return contigs(spark, d).select("chr", "length", F.md5("seq").alias("seq_md5"))


def _fasta(compression: str) -> Query:
    return lambda spark, d: text.fasta(spark, files.fasta(contigs(spark, d), compression)).select("chr", "length", F.md5("seq").alias("seq_md5"))


QUERIES |= {"src_fasta": _fasta("none"), "src_fasta_gz": _fasta("gzip")}


@query
def src_bed_file(spark, d):
    return text.bed(spark, files.bed(sim.bed(contigs(spark, d))))


def _shown(a: DataFrame) -> DataFrame:
    quals = F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals")
    float_ = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)
    return a.select("read_name", "flags", "chr", "pos", F.coalesce("mapq", F.lit(255)).alias("mapq"), "cigar", "seq", quals, float_("ec"), "np", float_("rq"))


@query
def src_sam(spark, d):
    return _shown(text.sam(spark, files.sam(alns(spark, d))))


@query
def src_bam(spark, d):
    """BAM files written from the alignments, read in splits of some 64 KB, so that records go from one into the next."""
    return _shown(bam.bam(spark, files.bam(alns(spark, d), contigs(spark, d)), split=1 << 16))


@query
def src_alignments(spark, d):
    return alns(spark, d).select("aln_id", "read_name", "flags", "chr", "pos", F.coalesce("mapq", F.lit(255)).alias("mapq"), "cigar", "seq", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"))


@query
def src_bed(spark, d):
    return sim.bed(contigs(spark, d))


@query
def aln_optional_tags(spark, d):
    return alns(spark, d).select("aln_id", F.col("ec").cast("double").alias("ec"), "np", F.col("rq").cast("double").alias("rq"))


@query
def out_name_column(spark, d):
    return alns(spark, d).select(F.lit("sample").alias("name"), "aln_id", "read_name")


@query
def filter_mapped_primary(spark, d):
    return mapped(spark, d).select("aln_id", "flags")


@query
def filter_supplementary(spark, d):
    return mapped(spark, d).filter(~pileup.flag(pileup.SUPPLEMENTARY)).select("aln_id", "flags")


@query
def aln_projection(spark, d):
    return stats(spark, d).select("aln_id", "read_name", "chr", "pos", "q_len", "alignment_type", "strand", "mapq")


@query
def cigar_span(spark, d):
    p = cigar.ops(F.col("cigar"))
    return alns(spark, d).select("aln_id", cigar.span(p).alias("span"), cigar.query_length(p).alias("query_length"))


@query
def cigar_coords(spark, d):
    return alns(spark, d).select("aln_id", F.posexplode(cigar.coords(F.col("cigar"), F.col("pos"))).alias("op_i", "o")).select("aln_id", "op_i", "o.op", "o.len", "o.ref_start", "o.query_start")


@query
def base_match_mismatch(spark, d):
    return events(spark, d, "match", "mismatch").groupBy("aln_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_pos").alias("places"), F.sum("qual").alias("quals"))


@query
def ins_homopolymer(spark, d):
    return events(spark, d, "ins").select("aln_id", "ref_pos", "n", "hp")


@query
def del_homopolymer(spark, d):
    return events(spark, d, "del").select("aln_id", "ref_pos", "hp")


@query
def gap_compressed(spark, d):
    return _rounded(stats(spark, d).select("aln_id", "gap_ins", "gap_del", "concordance_gc"))


@query
def aln_gc_content(spark, d):
    return _rounded(stats(spark, d).select("aln_id", "gc_content"))


@query
def aln_counts(spark, d):
    return stats(spark, d).select("aln_id", *aln_stats.COUNTS)


@query
def aln_stats_table(spark, d):
    return _rounded(stats(spark, d).select("aln_id", "read_len", "ref_cov", "gc_content", "concordance", "concordance_gc", "concordance_qv", "mean_qual", "errors"))


@query
def aln_mean_qual(spark, d):
    return alns(spark, d).select("aln_id", nm.mean_qual(F.col("quals")).alias("mean_qual"))


@query
def join_contig(spark, d):
    """By a join, whatever the size."""
    return pileup.with_contig(mapped(spark, d), contigs(spark, d), None, bounds(spark, d)[1]).select("aln_id", "contig_length", F.col("ref").alias("slice"))


@query
def join_contig_broadcast(spark, d):
    """By a broadcast of contigs up to BROADCAST_BASES; larger ones can't be held by every executor and are joined."""
    return rows(spark, d).select("aln_id", "contig_length", F.col("ref").alias("slice"))


@query
def join_bed_overlap(spark, d):
    """By place alone, so without the contigs' bases."""
    return iv.bed_overlap(pileup.placed(mapped(spark, d)), sim.bed(contigs(spark, d)))


QUERIES["intervals_bed"] = lambda spark, d: join_bed_overlap(spark, d).groupBy("feature_key").agg(F.count(F.lit(1)).alias("intervals"), F.sum("start").alias("starts"), F.sum("stop").alias("stops"))


@query
def join_base_interval(spark, d):
    return iv.stabbed(*with_kinds(spark, d, rows(spark, d)))


@query
def identical_intervals(spark, d):
    sums = iv.attributed(*with_kinds(spark, d, rows(spark, d)), everything=False).filter("not hist")
    return sums.groupBy("feature_key").agg(F.sum("intervals").alias("intervals"), F.sum("identical").alias("identical"))


def _made(kind) -> Query:
    return lambda spark, d: iv.generated(rows(spark, d), [kind()])


QUERIES |= {"intervals_homopolymer": _made(iv.homopolymers), "intervals_window": _made(lambda: iv.windows(20)), "intervals_window_pos": _made(lambda: iv.windows(25, True)), "intervals_border": _made(lambda: iv.borders(15)), "intervals_match": _made(lambda: iv.matches("acg"))}


@query
def intervals_union(spark, d):
    return all_intervals(spark, d).groupBy("feature_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


@query
def fn_revcomp(spark, d):
    return alns(spark, d).select("aln_id", nm.revcomp(F.col("seq")).alias("revcomp"))


@query
def fn_phred(spark, d):
    q = spark.range(0, 94).select(F.col("id").cast("int").alias("q"))
    return _rounded(q.select("q", (nm.error_of(F.col("q")) * 1e6).alias("error_ppm"), nm.qual_of(nm.error_of(F.col("q"))).alias("back")))


@query
def fn_concordance_qv(spark, d):
    return _rounded(stats(spark, d).select("aln_id", "concordance_qv"))


@query
def fn_rates(spark, d):
    s, n = stats(spark, d), F.col("matches") + F.col("mismatches") + F.col("non_hp_del") + F.col("hp_del")
    return _rounded(s.select("aln_id", n.alias("num_bases"), "errors", nm.per(F.col("matches"), n, 1000.0).alias("matches_per_kbp"), nm.fdiv(F.col("matches"), F.col("matches") + F.col("errors")).alias("identity")))


@query
def summary_yield(spark, d):
    return summaries.yields(pileup.primary(stats(spark, d)))


@query
def summary_identity(spark, d):
    return _rounded(summaries.identity(pileup.primary(stats(spark, d)), alns(spark, d).agg(F.count(F.lit(1)).alias("total_alns"))))


@query
def summary_cigar(spark, d):
    return _rounded(summaries.cigars(primary_rows(spark, d)))


@query
def summary_feature(spark, d):
    return _rounded(summaries.features(iv.attributed(*with_kinds(spark, d, primary_rows(spark, d)))))


@query
def summary_qual_score(spark, d):
    return _rounded(summaries.qual_scores(iv.attributed(primary_rows(spark, d), [iv.windows(20), iv.homopolymers()])))


def _bins(kind: str, step: float) -> Query:
    return lambda spark, d: _rounded(summaries.bins(pileup.primary(stats(spark, d)), [(kind, step)]))


QUERIES |= {"summary_bin_q_len": _bins("q_len", 10), "summary_bin_passes": _bins("subread_passes", 4), "summary_bin_mapq": _bins("mapq", 7), "summary_bin_mean_qual": _bins("mean_qual", 2), "summary_bin_gc": _bins("gc_content", 0.125), "summary_bin_qv": _bins("concordance_qv", 0.5)}
