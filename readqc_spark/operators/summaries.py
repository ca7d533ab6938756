"""The six summaries. Counts stay integers to the last projection, so results don't depend on the partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readqc_spark.functions.numeric import concordance_qv, error_of, fdiv, per, qual_of
from readqc_spark.operators.aln_stats import COUNTS

BIN_COLUMNS = {"q_len": "q_len", "subread_passes": "np", "mapq": "mapq", "mean_qual": "mean_qual", "gc_content": "gc_content", "concordance_qv": "concordance_qv"}
FLOAT_BINS = {"gc_content": 6, "concordance_qv": 2}


def _errors() -> Column:
    return F.col("mismatches") + F.col("non_hp_ins") + F.col("non_hp_del") + F.col("hp_ins") + F.col("hp_del")


def _bases() -> Column:
    return F.col("matches") + F.col("mismatches") + F.col("non_hp_del") + F.col("hp_del")


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]


def yields(stats: DataFrame) -> DataFrame:
    """min_empirical_q, yield_reads, yield_bases for 0, 5, to 70; always 15 rows. stats: primary alignments."""
    spark = stats.sparkSession
    reached = stats.filter(F.col("concordance_qv") >= 0).filter(~F.isnan("concordance_qv")).select("q_len", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("concordance_qv") / 5).cast("int") * 5, F.lit(70)), F.lit(5))).alias("min_empirical_q"))
    counted = reached.groupBy("min_empirical_q").agg(F.count(F.lit(1)).alias("r"), F.sum("q_len").alias("b"))
    steps = spark.range(0, 75, 5).select(F.col("id").cast("int").alias("min_empirical_q"))
    return steps.join(F.broadcast(counted), "min_empirical_q", "left").select("min_empirical_q", F.coalesce("r", F.lit(0)).cast("long").alias("yield_reads"), F.coalesce("b", F.lit(0)).cast("long").alias("yield_bases")).orderBy("min_empirical_q")


def identity(stats: DataFrame, total: DataFrame) -> DataFrame:
    """One row. total: one row, total_alns, the number of all records."""
    s = stats.agg(F.count(F.lit(1)).alias("primary_alns"), *_sums(), F.coalesce(F.sum("gap_ins"), F.lit(0)).alias("gap_ins"), F.coalesce(F.sum("gap_del"), F.lit(0)).alias("gap_del"))
    s = s.join(F.broadcast(total), F.lit(True)).withColumn("identity", fdiv(F.col("matches"), F.col("matches") + _errors()))
    return s.select("total_alns", "primary_alns", "identity", concordance_qv(F.col("identity"), _errors() > 0).alias("identity_qv"), fdiv(F.col("matches"), F.col("matches") + F.col("mismatches") + F.col("gap_ins") + F.col("gap_del")).alias("gap_compressed_identity"), *[per(F.col(c), _bases(), 1000.0).alias(f"{c}_per_kbp") for c in COUNTS])


def cigars(rows: DataFrame) -> DataFrame:
    """cigar, length, count and its share of the operation's total. rows: with ops."""
    each = rows.select(F.explode("ops").alias("o")).filter(F.col("o.op").isin("=", "X", "M", "I", "D"))
    return cigar_shares(each.groupBy(F.col("o.op").alias("cigar"), F.col("o.len").alias("length")).agg(F.count(F.lit(1)).alias("count")))


def cigar_shares(counts: DataFrame) -> DataFrame:
    """cigars() from counts: cigar, length, count."""
    return counts.withColumn("length_count_per_cigar", fdiv(F.col("count"), F.sum("count").over(W.partitionBy("cigar")))).orderBy("cigar", "length")


def bin_text(kind: str, step: float) -> str:
    """A bin's specification as printed: whole numbers plainly, others by their shortest decimals, never with an exponent."""
    return f"{kind}:{np.format_float_positional(step, trim='-')}" if kind in FLOAT_BINS else f"{kind}:{int(step)}"


def bin_of(kind: str, step: float) -> Column:
    x = F.col(BIN_COLUMNS[kind])
    if kind in FLOAT_BINS:
        low = F.floor(F.when(~F.isnan(x), x) / F.lit(float(step))) * F.lit(float(step))
        return F.when(F.isnan(x), x).otherwise(F.round(low, FLOAT_BINS[kind]))
    x = F.when(x.isNull(), F.raise_error(F.lit("Subread passes not found!"))).otherwise(x) if kind == "subread_passes" else x
    return (F.floor(x / F.lit(int(step))) * int(step)).cast("double")


def bins(stats: DataFrame, specs: list[tuple[str, float]]) -> DataFrame:
    """bin_type, bin and rates for every spec (kind, step), all in one pass; ordered by spec, then by bin."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(bin_text(k, s)).alias("bin_type"), bin_of(k, s).alias("bin")) for i, (k, s) in enumerate(specs)]))
    g = stats.withColumn("b", each).groupBy("b.i", "b.bin_type", "b.bin").agg(F.count(F.lit(1)).alias("num_reads"), *_sums()).withColumn("identity", fdiv(F.col("matches"), F.col("matches") + _errors()))
    return g.orderBy("i", "bin").select("bin_type", "bin", "num_reads", _bases().alias("num_bases"), "identity", concordance_qv(F.col("identity"), F.col("identity") != 1.0).alias("identity_qv"), *[per(F.col(c), _bases(), 1000.0).alias(f"{c}_per_kbp") for c in COUNTS])


def features(partials: DataFrame) -> DataFrame:
    """One row for each feature. partials: of primary alignments, as intervals.attributed() gives them.

    Errors are summed up from integers by quality, in the order of the qualities, so the sum doesn't depend on the partitions.
    """
    mine = partials.filter("feature_key <> 'all_alignments' or not hist")
    by = mine.filter("hist").groupBy("feature_key", "qual").agg(F.sum(F.col("matches") + F.col("mismatches")).alias("n"))
    listed = by.filter("qual is not null").groupBy("feature_key").agg(F.array_sort(F.collect_list(F.struct("qual", "n"))).alias("hist"))
    error = F.coalesce(F.aggregate("hist", F.lit(0.0), lambda a, x: a + x["n"] * error_of(x["qual"])), F.lit(0.0))
    g = mine.filter("not hist").groupBy("feature_key").agg(F.sum("intervals").alias("intervals"), F.sum("identical").alias("same"), *_sums())
    j = g.join(listed, "feature_key", "left").withColumns({"error": error, "identity": fdiv(F.col("matches"), F.col("matches") + _errors())})
    return j.orderBy("feature_key").select(
        F.trim("feature_key").alias("feature"), "intervals", fdiv(F.col("same"), F.col("intervals")).alias("identical_intervals"), "identity", concordance_qv(F.col("identity"), F.col("identity") != 1.0).alias("identity_qv"),
        qual_of(fdiv(F.col("error"), F.col("matches") + F.col("mismatches"))).alias("mean_qual"), per(_bases(), F.col("intervals")).alias("bases_per_interval"), *[per(F.col(c), F.col("intervals")).alias(f"{c}_per_interval") for c in COUNTS],
    )


def qual_scores(partials: DataFrame) -> DataFrame:
    """feature, qual_score, empirical_qv of all alignments and of each feature in partials (intervals.attributed())."""
    g = partials.filter("hist").groupBy("feature_key", "qual").agg(F.sum("matches").alias("m"), F.sum(F.col("matches") + F.col("mismatches")).alias("t"))
    return g.orderBy("feature_key", "qual").select(F.trim("feature_key").alias("feature"), F.col("qual").alias("qual_score"), concordance_qv(fdiv(F.col("m"), F.col("t")), F.col("m") != F.col("t")).alias("empirical_qv"))
