"""Contigs, alignments and intervals derived from the documents table by arithmetic, so that SQL can derive the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.operators import cigar

# What letters become, and the CIGAR strings with the lengths of the reads that fit them.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "AACCGGTTAACCGGTTAACCGGTTAN"
CIGARS = [("60M", 60), ("5S20M2I20M3D10M4S", 61), ("20=1X19=", 40), ("10M30N10M1I10M", 31), ("3H10M0I0D15M2H", 25), ("1=1X" * 55, 110), ("1M1I1M1D" * 30, 90), ("2S30M2I", 34)]
SPANS = [60, 53, 40, 60, 25, 110, 90, 30]
SHORTEST, COPIES = 200, 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its scan has fewer tasks than there are cores (a file of one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


_BASE_OF = np.zeros(256, np.uint8)
for _letters in (LETTERS, LETTERS.upper()):
    _BASE_OF[list(_letters.encode())] = list(BASES.encode())
#: Besides A-Z, what Unicode lower-cases to a letter of a-z (with a dot above, or alone).
_LOWERED = {"\u0130": "i", "\u212a": "k"}
#: So many bytes of text are looked up at once.
_AT_ONCE = 1 << 20


def _bases(texts: pa.Array) -> pa.Array:
    """translate(regexp_replace(lower(text), '[^a-z]+', ''), LETTERS, BASES) of each text, by a table of bytes; null as empty."""
    for letter, low in _LOWERED.items():
        if pc.any(pc.match_substring(texts, letter)).as_py():
            texts = pc.replace_substring(texts, letter, low)
    data, at = cigar.text_of(texts)
    parts, ends, i = [], [np.zeros(1, np.int64)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _AT_ONCE, "right")) - 1)
        found = _BASE_OF[data[at[i] : at[j]]]
        kept = found != 0
        parts.append(found[kept])
        ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(kept)])[at[i + 1 : j + 1] - at[i]])
        i = j
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.concatenate(ends).astype(np.int64)), pa.py_buffer(whole)).cast(pa.string())


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    seq = F.arrow_udf(_bases, "string")("text")
    # Through explode, as a filter on a length pushed to the scan would derive the bases again.
    d = d.select("doc_id", F.explode(F.filter(F.array(seq), lambda s: F.length(s) >= SHORTEST)).alias("seq"))
    return d.select(F.concat(F.lit("ctg"), F.col("doc_id").cast("string")).alias("chr"), "doc_id", "seq", F.length("seq").alias("length"))


def alignments(contig: DataFrame) -> DataFrame:
    a = contig.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("aln_id", F.col("doc_id") * COPIES + F.col("k"))
    which = ((F.col("doc_id") + F.col("k")) % len(CIGARS)).cast("int")
    a = a.withColumns({"pos": F.when(F.col("k") == 3, F.col("length") - F.get(F.array(*[F.lit(n) for n in SPANS]), which) + 1).otherwise(1 + (F.col("doc_id") * 13 + F.col("k") * 37) % (F.col("length") - 120)).cast("int"), "cigar": F.get(F.array(*[F.lit(c) for c, _ in CIGARS]), which), "q_len": F.get(F.array(*[F.lit(n) for _, n in CIGARS]), which)})
    i = F.col("aln_id")
    flags = F.when(F.col("k") % 2 == 1, 16).otherwise(0) + F.when(i % 11 == 0, 2048).otherwise(0) + F.when(i % 13 == 0, 256).otherwise(0) + F.when(i % 17 == 0, 4).otherwise(0)
    quals = F.transform(F.sequence(F.lit(1), F.col("q_len")), lambda x: (2 + (i * 7 + x * 13) % 40).cast("int"))
    return a.select(
        "aln_id", F.concat(F.lit("read"), i.cast("string")).alias("read_name"), flags.alias("flags"), "chr", "pos", F.when(i % 7 != 0, i % 61).cast("int").alias("mapq"), "cigar", F.rpad(F.substring("seq", F.col("pos"), F.col("q_len")), F.col("q_len"), F.lit("G")).alias("seq"), quals.alias("quals"),
        F.when(i % 5 != 0, (i % 40) / 4.0).cast("float").alias("ec"), (1 + i % 15).cast("int").alias("np"), F.when(i % 3 != 0, (i % 1024) / 1024.0).cast("float").alias("rq"),
    )


def bed(contig: DataFrame) -> DataFrame:
    j = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 50))).alias("j")
    return contig.select("chr", j).select("chr", (50 * F.col("j") + 1).cast("int").alias("start"), (50 * F.col("j") + 31 + 10 * (F.col("j") % 3)).cast("int").alias("stop"), F.concat(F.lit("f"), (F.col("j") % 4).cast("string")).alias("feature"))
