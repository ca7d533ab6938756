"""All results of a run from one pass over the alignments: each read is walked once, and what it gives goes to one small table.

The table has a row for each counted alignment, and rows of integer sums by feature, by feature and quality, and by CIGAR operation;
sums stand for a slab of reads each. Results are read from it alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc_spark.functions.numeric import mean_quals
from readqc_spark.operators import aln_stats, cigar, intervals, pileup

_CIGAR = "op string, length int, count long"
_SKIPPED = pileup.UNMAPPED | pileup.SECONDARY
_SHOWN = cigar.marks(cigar.COUNTED)


def _histogram(text: pa.Array) -> pa.RecordBatch:
    _, op, length = cigar.operations(*cigar.text_of(text))
    shown = _SHOWN[op]
    keys, counts = np.unique(length[shown] * 256 + op[shown], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([chr(k & 255) for k in keys.tolist()], pa.string()), pa.array((keys >> 8).astype(np.int32)), pa.array(counts.astype(np.int64))], ["op", "length", "count"])


def _walked(batches: Iterator[pa.RecordBatch], kinds) -> Iterator[pa.RecordBatch]:
    shape: pa.Schema | None = None
    for b in batches:
        if shape is None:
            sums = pa.schema([("feature_key", pa.string()), ("hist", pa.bool_()), ("qual", pa.int32()), *[(c, pa.int64()) for c in ("intervals", "identical", *intervals.COUNTS)]])
            own = pa.struct([("meta", b.schema.field("meta").type), ("q_len", pa.int32()), ("mean_qual", pa.int32()), *[(t, pa.int64()) for t in pileup.TALLIES]])
            shape = pa.schema([("total", pa.int64()), ("aln", own), *sums, ("op", pa.string()), ("length", pa.int32()), ("count", pa.int64())])

        def rows(columns: dict, n: int, shape=shape) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

        yield rows({"total": pa.array([len(b)], pa.int64())}, 1)
        flags = b["flags"].to_numpy(zero_copy_only=False)
        b = b.filter(pa.array(flags & _SKIPPED == 0))
        for c, w in pileup.slabs(b):
            n = len(c["pos"])
            lengths = pa.array(np.diff(cigar.text_of(c["seq"])[1]).astype(np.int32))
            parts = [c["meta"], lengths, pa.array(mean_quals(c["quals"])), *[pa.array(x) for x in pileup._counts(w, n)]]
            yield rows({"aln": pa.StructArray.from_arrays(parts, fields=list(shape.field("aln").type))}, n)
            main = c["flags"].to_numpy(zero_copy_only=False) & pileup.SUPPLEMENTARY == 0
            if not main.all():
                kept = pa.array(main)
                c = {k: x.filter(kept) for k, x in c.items()}
                w = pileup.walk(c["pos"], c["cigar"], c["seq"], c["ref"], c["slice_start"])
            if not len(c["pos"]):
                continue
            for part in [*intervals.partial_sums(intervals.Slab(c), w, c["quals"], kinds), _histogram(c["cigar"])]:
                yield rows({k: part[k] for k in part.schema.names}, len(part))


def walked_once(rows: DataFrame, kinds: Sequence) -> DataFrame:
    """total (records of a batch) | aln (a counted alignment) | sums by feature_key (intervals.PARTIAL) | op, length, count.

    rows: with_contig's, of all records; unmapped and secondary ones are counted only.
    """
    meta = [f for f in rows.select(*aln_stats.META).schema]
    own = T.StructType([T.StructField("meta", T.StructType(meta)), *T._parse_datatype_string("q_len int, mean_qual int, " + ", ".join(f"{t} long" for t in pileup.TALLIES)).fields])
    more = T._parse_datatype_string(f"{intervals.PARTIAL}, {_CIGAR}").fields
    shape = T.StructType([T.StructField("total", T.LongType()), T.StructField("aln", own), *more])
    some = rows.withColumn("meta", F.struct(*aln_stats.META))
    return pileup.walked(some, "meta", *intervals._columns(rows)).mapInArrow(partial(_walked, kinds=list(kinds)), shape)
