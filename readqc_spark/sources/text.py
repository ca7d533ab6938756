"""FASTA, BED and SAM text as DataFrames, read by Spark (compressed by extension, any file system that Spark reads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, seq, length: name up to the first white space, bases in upper case. Of equal names the last in the file counts."""
    raw = spark.read.text(path, lineSep="\n>").withColumn("at", F.monotonically_increasing_id())
    record = F.regexp_replace("value", "^[\\s>]+", "")
    rows = raw.select("at", F.regexp_extract(record, r"^(\S+)", 1).alias("chr"), F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")).alias("seq")).filter("chr <> ''")
    return rows.groupBy("chr").agg(F.max_by("seq", "at").alias("seq")).withColumn("length", F.length("seq"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, stop, feature; 1-based and half-open; a missing feature is none, further columns are ignored, bad numbers raise."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("chr"), (F.get(parts, F.lit(1)).cast("int") + 1).alias("start"), (F.get(parts, F.lit(2)).cast("int") + 1).alias("stop"), F.coalesce(F.get(parts, F.lit(3)), F.lit("none")).alias("feature"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments from SAM text."""
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("@")) & (F.length("value") > 0)).withColumn("aln_id", F.monotonically_increasing_id())
    p = F.split("value", "\t")
    # Header lines are filtered, but a cast may be planned ahead of that filter, so it must not see them.
    at = lambda k: F.when(~F.startswith("value", F.lit("@")), F.get(p, F.lit(k)))
    tags = F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0)))

    def tag(name: str, kind: str) -> Column:
        """A tag's value; one of another type raises."""
        found = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(name + ":"))), F.lit(0))
        wrong = F.raise_error(F.concat(F.lit("tag of another type than expected: "), found))
        return F.when(F.startswith(found, F.lit(f"{name}:{kind}:")), F.substring(found, 6, 1_000_000)).when(found.isNotNull(), wrong)

    quals = F.when(at(10) == "*", F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.filter(F.split(at(10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33))
    return rows.select("aln_id", at(0).alias("read_name"), at(1).cast("int").alias("flags"), F.when(at(2) != "*", at(2)).alias("chr"), at(3).cast("int").alias("pos"), F.when(at(4) != "255", at(4)).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), quals.alias("quals"), tag("ec", "f").cast("float").alias("ec"), tag("np", "i").cast("int").alias("np"), tag("rq", "f").cast("float").alias("rq"))
