"""Phred mathematics and rates that keep to IEEE rules where Spark's ANSI mode would raise or give null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PERFECT_QV = 75.0


def fdiv(n: Column, d: Column) -> Column:
    """n / d as doubles; NaN for a zero denominator (all numerators here are zero then)."""
    return F.when(d == 0, F.lit(float("nan"))).otherwise(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)))


def error_of(qual: Column) -> Column:
    return F.pow(F.lit(10.0), -qual.cast("double") / 10.0)


def qual_of(error: Column) -> Column:
    """-10 log10(error); infinity for zero, NaN for NaN."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(-10.0 * F.log10(error))


def concordance_qv(identity: Column, has_errors: Column) -> Column:
    return F.when(has_errors, F.when(identity == 1, F.lit(float("inf"))).otherwise(-10.0 * F.log10(1.0 - identity))).otherwise(F.lit(PERFECT_QV))


_ERRORS = 10.0 ** (-np.arange(256) / 10)


def mean_quals(quals: pa.Array) -> np.ndarray:
    """Mean error of all bases of each list as a Phred value, rounded half up, 0 to 255; 0 for an empty list."""
    q = quals.fill_null([]) if quals.null_count else quals
    n = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = q.flatten().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    inside = (values >= 0) & (values < 256)
    error = _ERRORS[values] if inside.all() else 10.0 ** (-values / 10)
    total, some = np.zeros(len(n)), n > 0
    if some.any():
        total[some] = np.add.reduceat(error, (np.cumsum(n) - n)[some])
    with np.errstate(divide="ignore", invalid="ignore"):
        phred = np.floor(-10 * np.log10(total / n) + 0.5)
    return np.where(np.isnan(phred), 0, np.clip(phred, 0, 255)).astype(np.int32)


def mean_qual(quals: Column) -> Column:
    """mean_quals() of a column of arrays of numbers."""
    return F.arrow_udf(lambda q: pa.array(mean_quals(q)), "int")(quals)


def per(n: Column, d: Column, scale: float = 1.0) -> Column:
    return fdiv(n, d) * scale


def revcomp(seq: Column) -> Column:
    """Reverse complement; bases but ACGTN become NUL, which matches nothing."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTN]", "\0"), "ACGTN", "TGCAN"))
