"""One row of statistics for each alignment, without a shuffle after the join with the contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc_spark.functions.numeric import concordance_qv, fdiv, mean_quals
from readqc_spark.operators import cigar, pileup
from readqc_spark.operators.pileup import REVERSE, SUPPLEMENTARY, flag

COUNTS = ("matches", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del")


META = ("aln_id", "read_name", "chr", "pos", "flags", "mapq", "ec", "np", "rq", "contig_length")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c, w in pileup.slabs(b):
            more = [pa.array(np.diff(cigar.text_of(c["seq"])[1]).astype(np.int32)), pa.array(mean_quals(c["quals"])), *[pa.array(x) for x in pileup._counts(w, len(c["pos"]))]]
            yield pa.RecordBatch.from_arrays([c[m] for m in META] + more, [*META, "q_len", "mean_qual", *pileup.TALLIES])


def stats(rows: DataFrame) -> DataFrame:
    """The per-alignment table of rows of with_contig: identity columns, counts and what derives from them."""
    more = T._parse_datatype_string("q_len int, mean_qual int, " + ", ".join(f"{t} long" for t in pileup.TALLIES)).fields
    shape = T.StructType([*rows.select(*META).schema.fields, *more])
    return derived(pileup.walked(rows, *[m for m in META if m not in ("aln_id", "pos")]).mapInArrow(_counted, shape))


def derived(counted: DataFrame) -> DataFrame:
    """stats() from META, q_len, mean_qual and the TALLIES."""
    c = F.col
    errors = c("mismatches") + c("non_hp_ins") + c("non_hp_del") + c("hp_ins") + c("hp_del")
    read_len = c("matches") + c("mismatches") + c("non_hp_del") + c("hp_del")
    out = counted.withColumns({
        "mapq": F.coalesce("mapq", F.lit(255)), "supplementary": flag(SUPPLEMENTARY), "strand": F.when(flag(REVERSE), "-").otherwise("+"),
        "alignment_type": F.when(flag(SUPPLEMENTARY), "supplementary").otherwise("primary"), "errors": errors, "read_len": read_len,
    })
    out = out.withColumns({"ref_cov": fdiv(c("read_len"), c("contig_length")), "gc_content": fdiv(c("gc_bases"), c("read_len")), "concordance": fdiv(c("matches"), c("matches") + c("errors")), "concordance_gc": fdiv(c("matches"), c("matches") + c("mismatches") + c("gap_ins") + c("gap_del"))})
    out = out.withColumn("concordance_qv", concordance_qv(c("concordance"), c("errors") > 0))
    ids = ["aln_id", "read_name", "chr", "pos", "q_len", F.col("ec").cast("double").alias("ec"), "np", F.col("rq").cast("double").alias("rq"), "alignment_type", "supplementary", "strand", "mapq", "mean_qual"]
    return out.select(*ids, "read_len", "ref_cov", "gc_content", "concordance", "concordance_gc", "concordance_qv", *COUNTS, "gap_ins", "gap_del", "errors")
