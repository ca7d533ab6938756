"""Summaries over a stream of alignments: every state is a table of integer sums, so batches merge by adding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readqc_spark.operators import aln_stats, pileup

STATE = (*aln_stats.COUNTS, "gap_ins", "gap_del")


def batch_state(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row of integer sums over a batch's primary alignments."""
    stats = pileup.primary(aln_stats.stats(pileup.with_contig(pileup.mapped_primary(alignments), contigs)))
    return stats.agg(F.count(F.lit(1)).alias("primary_alns"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in STATE])


def start(stream: DataFrame, contigs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's sums to path, under the batch's number, so that a batch that runs again replaces its own."""
    return stream.writeStream.foreachBatch(lambda df, n: batch_state(df, contigs).write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).start()


def merged(spark, path: str) -> DataFrame:
    """The sums over all batches."""
    return spark.read.parquet(path).agg(*[F.sum(c).alias(c) for c in ("primary_alns", *STATE)])
