"""analyze(): all results of a run as DataFrames; main(): the command line."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.operators import aln_stats, onepass, pileup, summaries
from readqc_spark.operators import intervals as iv
from readqc_spark.sources import sinks, text
from readqc_spark.sources.bam import bam

BIN_KINDS = tuple(summaries.BIN_COLUMNS)


def bin_spec(s: str) -> tuple[str, float]:
    """kind:step; a third part is ignored."""
    parts = s.split(":")
    if len(parts) < 2:
        raise ValueError(f"{s}: a kind and a step, joined by a colon, are wanted")
    if parts[0] not in BIN_KINDS:
        raise ValueError(f"{parts[0]}: reads can be binned by {', '.join(BIN_KINDS)}")
    step = float(parts[1]) if parts[0] in summaries.FLOAT_BINS else int(parts[1])
    if step <= 0:
        raise ValueError("a step must be positive")
    return parts[0], step


@dataclass
class Intervals:
    homopolymers: bool = False
    beds: list[DataFrame] = field(default_factory=list)
    windows: list[int] = field(default_factory=list)
    windows_pos: list[int] = field(default_factory=list)
    borders: list[int] = field(default_factory=list)
    matches: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if any(w <= 0 for w in [*self.windows, *self.windows_pos, *self.borders]) or not all(self.matches):
            raise ValueError("widths must be positive and sequences not empty")

    def kinds(self, rows: DataFrame, placed: DataFrame | None = None) -> tuple[DataFrame, list]:
        """(rows, generators); rows carry what large BED tables have for them. placed: as intervals.with_beds takes it."""
        made = [iv.homopolymers()] if self.homopolymers else []
        made += [iv.windows(w) for w in self.windows] + [iv.windows(w, True) for w in self.windows_pos] + [iv.borders(w) for w in self.borders] + [iv.matches(m) for m in self.matches]
        rows, beds = iv.with_beds(rows, self.beds, placed)
        return rows, made + beds


def analyze(alignments: DataFrame, contigs: DataFrame, intervals: Intervals | None = None, bins: list[str] | None = None) -> dict[str, DataFrame]:
    """per_aln, yield, identity, cigar, qual_score; feature with intervals; bin with bins.

    The alignments are read and walked once: all results come from one table of a row for each read and of integer sums, which Spark
    keeps (in memory, else on disk) until the session ends or the caller clears its cache.
    """
    wanted = [bin_spec(b) for b in bins or []]
    bases, longest = (n or 0 for n in contigs.agg(F.sum("length"), F.max("length")).first())
    counted = F.col("flags").bitwiseAND(pileup.UNMAPPED | pileup.SECONDARY) == 0
    cleared = alignments.withColumns({"cigar": F.when(counted, F.col("cigar")), "chr": F.when(counted, F.col("chr"))})
    joined = pileup.with_contig(cleared, contigs, bases, longest)
    rows, kinds = intervals.kinds(joined, pileup.placed(cleared)) if intervals else (joined, [])
    one = onepass.walked_once(rows, kinds).persist(StorageLevel.MEMORY_AND_DISK)
    stats = aln_stats.derived(one.filter("aln is not null").select("aln.meta.*", "aln.q_len", "aln.mean_qual", *[f"aln.{t}" for t in pileup.TALLIES]))
    main, partials = pileup.primary(stats), one.filter("feature_key is not null")
    total = one.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_alns"))
    shares = one.filter("op is not null").groupBy(F.col("op").alias("cigar"), "length").agg(F.sum("count").alias("count"))
    out = {"per_aln": stats, "yield": summaries.yields(main), "identity": summaries.identity(main, total), "cigar": summaries.cigar_shares(shares), "qual_score": summaries.qual_scores(partials)}
    if kinds:
        out["feature"] = summaries.features(partials)
    if wanted:
        out["bin"] = summaries.bins(main, wanted)
    return out


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return bam(spark, path) if path.endswith(".bam") else text.sam(spark, path) if ".sam" in path else spark.read.parquet(path)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="readqc_spark", description="Sequencing-error statistics of aligned reads.")
    p.add_argument("input"), p.add_argument("reference"), p.add_argument("stats_prefix")
    p.add_argument("-n", "--name-column"), p.add_argument("--no-per-aln-stats", action="store_true")
    p.add_argument("-b", "--bin-types", nargs="+", action="extend", default=[])
    p.add_argument("--intervals-bed", nargs="+", action="extend", default=[]), p.add_argument("--intervals-hp", action="store_true")
    for name in ("window", "window-pos", "border"):
        p.add_argument(f"--intervals-{name}", nargs="+", action="extend", type=int, default=[])
    p.add_argument("--intervals-match", nargs="+", action="extend", default=[]), p.add_argument("-t", "--threads", type=int, default=0)
    a = p.parse_args(args)
    began = time.monotonic()
    spark = SparkSession.builder.master(f"local[{a.threads or '*'}]").getOrCreate() if SparkSession.getActiveSession() is None else SparkSession.getActiveSession()
    wanted = Intervals(a.intervals_hp, [text.bed(spark, b) for b in a.intervals_bed], a.intervals_window, a.intervals_window_pos, a.intervals_border, [m.upper() for m in a.intervals_match])
    out = analyze(read_alignments(spark, a.input), text.fasta(spark, a.reference), wanted, a.bin_types)
    for name, df in out.items():
        if name != "per_aln":
            sinks.one_file(sinks.named(df, a.name_column), f"{a.stats_prefix}.summary_{name}_stats.csv")
        elif not a.no_per_aln_stats:
            sinks.by_tasks(sinks.named(sinks.per_aln(df), a.name_column), f"{a.stats_prefix}.per_aln_stats.csv.gz")
    print(f"Run time (s): {int(time.monotonic() - began)}")
