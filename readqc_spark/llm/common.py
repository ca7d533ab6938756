"""What the operators of this subpackage share: inputs, checkpoints and hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null as empty) and the columns named in more; all others are left behind."""
    lean(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])


def quoted(name: str) -> str:
    """A column's name as it can be put in an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs in one, so that no name can clash), doc_id and text (null as empty) for each row of docs."""
    every = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    return docs.select(every.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def id_text(doc_id: Column) -> Column:
    """An id as text, null ids told apart from others."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def repeated(df: DataFrame, times: str, at: str) -> DataFrame:
    """Each row of df as often as its column times says, numbered from 0 in column at. No array holds more than 65,536 numbers, or their blocks."""
    block = 1 << 16
    blocks = df.filter(F.col(times) > 0).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / block))))
    last = F.least(F.lit(block), F.col(times) - F.col(at) * block) - 1
    return blocks.withColumn(at, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda x: x + F.col(at) * block)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode alone (tests).

    What operators write here (checkpoints, media, shards, stages) stays until its owner removes it; Spark removes checkpoints by
    itself where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(spark: SparkSession) -> None:
    """Arrow batches of this session hold 8 MB and 2,000 rows at most, unless they were set to other than Spark's defaults: a worker holds a batch whole."""
    for key, usual, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, value)


def give_back() -> None:
    """Memory that Arrow and the C library hold for later use goes back to the system, where they can do that: else a driver keeps what one step took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library than glibc


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_SLAB = 1 << 16
with np.errstate(over="ignore"):
    _POWER, _BACK = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SLAB, r, np.uint64)])) for r in (_RADIX, _INVERSE))


def parts_of(column: pa.Array, limit: int = 4 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (index, UTF-8 bytes) of about limit bytes together, or of one longer text; null counts as empty."""
    whole = column.cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    view, null = memoryview(data) if data is not None else memoryview(b""), whole.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(whole):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield [(k, b"" if null[k] else bytes(view[at[k] : at[k + 1]])) for k in range(i, j)]
        i = j


def batches_of(strings, limit: int = 4 << 20):
    """Lists of (index, UTF-8 bytes) of about limit bytes together, or of one longer text."""
    some, size = [], 0
    for i, s in enumerate(strings):
        b = s.encode("utf-8", "surrogatepass")
        if some and size + len(b) > limit:
            yield some
            some, size = [], 0
        some.append((i, b))
        size += len(b) + 1
    if some:
        yield some


def word_hashes(parts: list[bytes], parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, how many words each part has); A-Z count as a-z. parting: for each byte, whether it parts words.

    A word's hash is that of a polynomial of its bytes. It is summed up slab by slab, also within a word, so that besides the bytes
    themselves a few MB are held, however long a word is.
    """
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    space = parting[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(buf), _SLAB):
            some = buf[low : low + _SLAB]
            high = low + len(some)
            i, j = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high))
            if i == j:
                continue
            total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[some] * _POWER[: len(some)])])
            a, b = np.maximum(starts[i:j], low) - low, np.minimum(ends[i:j], high) - low
            part = (total[b] - total[a]) * _BACK[a]
            if starts[i] < low:  # goes on from the slab before
                part[0] *= np.uint64(pow(int(_RADIX), low - int(starts[i]), 1 << 64))
            out[i:j] += part
        return mix64(out + (ends - starts).astype(np.uint64)), counts
