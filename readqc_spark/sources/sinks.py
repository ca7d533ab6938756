"""CSV text as users of the command line expect it: fixed decimals, a constant name column, one file for each summary."""

from __future__ import annotations

import gzip
import math
import os
import shutil
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_ALN = ["read", "chr", "pos", "read_length", "effective_coverage", "subread_passes", "predicted_concordance", "alignment_type", "strand", "alignment_mapq", "mean_quality", "aligned_read_length", "reference_coverage", "gc_content", "concordance", "gap_compressed_concordance", "concordance_qv", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del"]


#: Decimals by column, and by kind of bin; six for all others.
PLACES = {"concordance_qv": 2, "empirical_qv": 2, "effective_coverage": 2}
BIN_PLACES = {"gc_content": 6, "concordance_qv": 2}
#: Texts that are cut to so many characters where output must look as users of the command line know it.
CUT = {"effective_coverage": 2, "predicted_concordance": 6}


def number(x, name: str, compat: bool = False) -> str:
    """Decimals as printed: exact binary value, ties to even; NaN and inf by name; null empty. compat: CUT holds."""
    if x is None:
        return ""
    if not isinstance(x, float):
        return str(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = f"{x:.{PLACES.get(name, 6)}f}"
    return text[: CUT[name]] if compat and name in CUT else text


def bin_number(x: float, bin_type: str) -> str:
    """A bin's lower end: whole numbers plainly, others by their kind's decimals."""
    places = BIN_PLACES.get(bin_type.split(":")[0])
    return number(x, "bin") if math.isnan(x) or math.isinf(x) else f"{x:.{places}f}" if places else str(int(x))


def per_aln(stats: DataFrame) -> DataFrame:
    """The per-alignment columns by their output names."""
    names = ("read_name", "chr", "pos", "q_len", "ec", "np", "rq", "alignment_type", "strand", "mapq", "mean_qual", "read_len", "ref_cov", "gc_content", "concordance", "concordance_gc", "concordance_qv", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del")
    return stats.select(*[F.col(x).alias(n) for x, n in zip(names, PER_ALN, strict=True)])


def named(df: DataFrame, name: str | None) -> DataFrame:
    return df if name is None else df.select(F.lit(name).alias("name"), "*")


def line(columns: list[str], row, compat: bool = False) -> str:
    return ",".join(bin_number(row[c], row["bin_type"]) if c == "bin" else number(row[c], c, compat) for c in columns)


def one_file(df: DataFrame, path: str) -> None:
    """One CSV file in the frame's order, for summaries: an iterator holds one partition of them."""
    with open(path, "w") as f:
        f.write(",".join(df.columns) + "\n")
        f.writelines(line(df.columns, r) + "\n" for r in df.toLocalIterator())


def _printed(batches: Iterator[pa.RecordBatch], compat: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([line(b.schema.names, r, compat) for r in b.to_pylist()], pa.string())], ["value"])


def many_files(df: DataFrame, path: str, compat: bool = True) -> None:
    """A folder of gzip CSV files without headers, printed and written by the tasks."""
    df.mapInArrow(partial(_printed, compat=compat), "value string").write.mode("overwrite").option("compression", "gzip").text(path)


def by_tasks(df: DataFrame, path: str, compat: bool = True) -> None:
    """One gzip CSV file: the tasks print and compress, and their parts are then put one after the other, as gzip allows.

    For a path with a scheme the parts stay a folder, path + ".parts", next to a header in path + ".columns".
    """
    many_files(df, f"{path}.parts", compat)
    header = ",".join(df.columns) + "\n"
    if "://" in path:
        df.sparkSession.createDataFrame([(header.strip(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.columns")
        return
    with open(path, "wb") as f:
        f.write(gzip.compress(header.encode()))
        for name in sorted(os.listdir(f"{path}.parts")):
            if name.startswith("part-"):
                with open(os.path.join(f"{path}.parts", name), "rb") as part:
                    shutil.copyfileobj(part, f)
    shutil.rmtree(f"{path}.parts")
