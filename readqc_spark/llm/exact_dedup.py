"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a hash of the last eight bytes has twelve zero bits, so equal passages are cut alike wherever they
stand. A text's recipe is the ordered list of its chunks' 64-bit identifiers. Only identifiers and digests leave the task that
reads a text: no text is shuffled. An identifier is verified when all chunks that bear it have the same length and SHA-256;
texts with an identifier that fails are compared by their ordered SHA-256 digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import cut, parts_of, texts

SHORTEST, LONGEST, ZERO_BITS, WINDOW = 512, 65536, 12, 8
_SLAB = 4 << 20


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data. They depend on its bytes alone; every chunk but the last has SHORTEST to LONGEST bytes."""
    found: list[np.ndarray] = []
    for at in range(0, len(data) - WINDOW + 1, _SLAB):
        part = data[at : at + _SLAB + WINDOW - 1]
        n = len(part) - WINDOW + 1
        seen = np.empty(n, np.uint64)
        for k in range(min(WINDOW, n)):
            seen[k::WINDOW] = np.frombuffer(part, "<u8", (len(part) - k) // 8, k)[: len(seen[k::WINDOW])]
        with np.errstate(over="ignore"):
            seen *= np.uint64(0x9E3779B97F4A7C15)
        found.append(np.flatnonzero(seen >> np.uint64(64 - ZERO_BITS) == 0) + at + WINDOW)
    ends, last = [], 0
    for end in [*(np.concatenate(found).tolist() if found else []), len(data)]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST or end == len(data) and end > last:
            ends.append(end)
            last = end
    return ends


RECIPE = "doc_id long, text_sha256 string, n_bytes long, chunk_ids array<long>, chunk_digests array<binary>"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole, sizes, ids, digests = [], [], [], []
        for some in parts_of(b["text"]):
            for _, data in some:
                last, mine, told = 0, [], []
                for end in cut_points(data):
                    chunk = data[last:end]
                    mine.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                    told.append(hashlib.sha256(chunk).digest() + len(chunk).to_bytes(4, "big"))
                    last = end
                whole.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
                ids.append(mine)
                digests.append(told)
        columns = [pa.array(whole, pa.string()), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], [x.split()[0] for x in RECIPE.split(", ")])


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, n_bytes, and the ordered lists chunk_ids and chunk_digests, a row for each row of docs.

    A null text counts as empty and has no chunks. Very long texts are read whole, one at a time. An empty table gives an empty result.
    """
    return texts(docs).mapInArrow(_recipes, RECIPE)


def unverified(lists: DataFrame) -> DataFrame:
    """chunk_id of every identifier whose chunks differ; none, unless 64-bit hashes collide."""
    one = lists.select(F.explode(F.arrays_zip("chunk_ids", "chunk_digests")).alias("c")).select(F.col("c.chunk_ids").alias("chunk_id"), F.hex("c.chunk_digests").alias("d"))
    return one.groupBy("chunk_id").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("chunk_id")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for each row of docs (doc_id, text).

    A null text counts as empty; empty texts are equal. The largest doc_id of equal texts stays (a null doc_id counts as
    smallest); of rows that repeat both doc_id and text, one stays. Very long texts are read whole. An empty table gives an empty
    result. Further columns of docs, whatever their names, aren't looked at. Hot groups are counted before the shuffle; the join
    back is one that adaptive execution splits.
    """
    lists = cut(recipes(docs).withColumn("row", F.monotonically_increasing_id()))
    wrong = cut(unverified(lists))
    recipe = F.transform("chunk_ids", lambda x: x.cast("string"))
    if wrong.isEmpty():
        keyed = lists.withColumn("recipe", F.col("chunk_ids"))
    else:
        hit = lists.select("text_sha256", F.explode("chunk_ids").alias("chunk_id")).join(wrong, "chunk_id", "left_semi").select("text_sha256").distinct().withColumn("hit", F.lit(True))
        keyed = lists.join(hit, "text_sha256", "left").withColumn("recipe", F.when(F.col("hit"), F.transform("chunk_digests", lambda x: F.hex(x))).otherwise(recipe))
    keyed = keyed.select("row", "doc_id", "text_sha256", "recipe", F.size("chunk_ids").alias("n_chunks"))
    groups = keyed.groupBy("recipe").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(groups, "recipe").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_chunks")
