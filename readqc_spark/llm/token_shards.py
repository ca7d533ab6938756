"""Training-order materialisation: token ids in fixed-stride binary shards, in the order of a keyed permutation.

1. The most sequences that a text can give follows from its bytes, so a scan that tokenises nothing numbers the places for all
   sequences, part by part. Each sequence has a place in [0, places).
2. A keyed Feistel network, walked again while it leaves that range, permutes the places. A shard is a range of permuted places.
3. Sequences are shuffled once, by ranges of permuted places; a task sorts its shards and writes each as records of one length to one file, under a temporary
   name that is then moved, so that a task that runs again replaces its file whole.
4. A manifest holds each shard's count. Places that no sequence took leave no gap: a record's global slot is its shard's first slot and
   its number there.

The input must be read alike twice (files or a checkpoint); a part that gives other counts raises an error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.llm.byte_pairs import byte_pairs
from readqc_spark.llm.common import cut, mix64, shared_dir, texts
from readqc_spark.llm.pieces import MODEL, loaded, model_of

LENGTH, PER_SHARD, KEY, ROUNDS = 512, 32768, 20240229, 6
#: Shards are written and read by so many tasks at most, each with a range of them.
MOST_TASKS = 50_000
HEAD = struct.Struct("<qiii")  # doc_id, 1 if it is null, number in its document, tokens


def feistel(x: np.ndarray, half: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of the integers of 2 * half bits; back: its inverse."""
    mask = np.uint64((1 << half) - 1)
    left, right = x.astype(np.uint64) >> np.uint64(half), x.astype(np.uint64) & mask
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 ^ key))
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ k) & mask)
    return left << np.uint64(half) | right


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: the network is walked again until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = feistel(x, half, key, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = feistel(out[far], half, key, back)
    return out.astype(np.int64)


def _room(text_bytes: int, length: int) -> int:
    return -(-(text_bytes + 1) // length)


def _cut_up(frames: Iterator[pd.DataFrame], model, length: int, places: int, first, per_shard: int, key: int) -> Iterator[pd.DataFrame]:
    m = byte_pairs(loaded(model))
    at, end = first.value[TaskContext.get().partitionId()]
    for f in frames:
        for k in range(0, len(f), 300):
            part, rows = f.iloc[k : k + 300], []
            for doc, text, tokens in zip(part["doc_id"].astype(object), part["text"], m.encode(part["text"].tolist()), strict=True):
                rows += [(at + j, None if pd.isna(doc) else int(doc), j, tokens[j * length : (j + 1) * length].tobytes()) for j in range(-(-len(tokens) // length))]
                at += _room(len(text.encode("utf-8", "surrogatepass")), length)
            out = pd.DataFrame(rows, columns=["place", "doc_id", "part", "tokens"])
            out["place"] = permuted(out["place"].to_numpy(), places, key) if len(out) else 0
            yield out.assign(shard=out["place"] // per_shard)
    if at != end:
        raise RuntimeError("the input was read otherwise the second time")


def _write(frames: Iterator[pd.DataFrame], uri: str, length: int) -> Iterator[pd.DataFrame]:
    store, path = fs.FileSystem.from_uri(uri)
    shard, out, count, crc, temporary = None, None, 0, 0, ""

    def close() -> list[tuple]:
        if out is None:
            return []
        out.close()
        store.move(temporary, f"{path}/shard-{shard:08d}.bin")
        return [(shard, count, crc)]

    for f in frames:
        done = []
        for s, doc, part, tokens in zip(f["shard"], f["doc_id"], f["part"], f["tokens"], strict=True):
            if s != shard:
                done += close()
                shard, count, crc, temporary = int(s), 0, 0, f"{path}/_writing-{int(s):08d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(temporary)
            record = HEAD.pack(0 if pd.isna(doc) else int(doc), int(pd.isna(doc)), int(part), len(tokens) // 2) + tokens + bytes(2 * length - len(tokens))
            out.write(record)
            count, crc = count + 1, zlib.crc32(record, crc)
        yield pd.DataFrame(done, columns=["shard", "records", "crc32"])
    yield pd.DataFrame(close(), columns=["shard", "records", "crc32"])


def materialise(docs: DataFrame, path: str | None = None, model: str = MODEL, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> str:
    """Write the token sequences of docs (doc_id, text) to path (a new folder in the shared one if None); give the path.

    Texts without tokens (null, empty) have no sequence; an empty table gives a manifest without shards. Repeated rows are written as
    often as they occur. The ids are the SentencePiece model's for the whole text, however long (byte_pairs). Ids must be below 65,536. Shards are files of records of one length, HEAD and length little-endian uint16.
    """
    spark = docs.sparkSession
    uri = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else f"file://{uri}"
    store, local = fs.FileSystem.from_uri(uri)
    store.create_dir(local, recursive=True)
    text = texts(docs)
    room = F.ceil((F.octet_length("text") + 1) / F.lit(float(length))).cast("long")
    parts = sorted((r["p"], r["n"]) for r in text.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(room).alias("n")).collect())
    first, places = {}, 0
    for p, n in parts:
        first[p] = (places, places + n)
        places += n
    proto, sc = model_of(spark, model), spark.sparkContext
    if loaded(proto).sp.get_piece_size() > 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    begin = sc.broadcast(dict.fromkeys(range(text.rdd.getNumPartitions()), (0, 0)) | first)
    rows = text.mapInPandas(partial(_cut_up, model=proto, length=length, places=max(places, 1), first=begin, per_shard=per_shard, key=key), "place long, doc_id long, part int, tokens binary, shard long")
    shards = max(1, -(-places // per_shard))
    tasks = min(shards, MOST_TASKS)
    # Ranges of shards, and so of permuted places, by number: nothing need be sampled to find their bounds.
    dealt = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(float(shards))).cast("int")).sortWithinPartitions("shard", "place")
    done = cut(dealt.mapInPandas(partial(_write, uri=uri, length=length), "shard long, records long, crc32 long")).orderBy("shard").collect()
    manifest = {"length": length, "stride": HEAD.size + 2 * length, "key": key, "places": places, "shards": [[r["shard"], r["records"], r["crc32"]] for r in done]}
    with store.open_output_stream(f"{local}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return uri


def manifest_of(uri: str) -> dict:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    with store.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def _read(frames: Iterator[pd.DataFrame], uri: str, stride: int) -> Iterator[pd.DataFrame]:
    store, path = fs.FileSystem.from_uri(uri)
    for f in frames:
        for r in f.itertuples():
            with store.open_input_file(f"{path}/shard-{r.shard:08d}.bin") as file:
                for a in range(r.start, r.stop, 2048):
                    b = min(a + 2048, r.stop)
                    data, rows = file.read_at((b - a) * stride, a * stride), []
                    for k in range(b - a):
                        doc, null, part, n = HEAD.unpack_from(data, k * stride)
                        rows.append((r.first + a + k, r.shard, (a + k) * stride, None if null else doc, part, data[k * stride + HEAD.size : k * stride + HEAD.size + 2 * n]))
                    yield pd.DataFrame(rows, columns=["slot", "shard", "offset", "doc_id", "part", "tokens"])


def read_shards(spark: SparkSession, uri: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, offset, doc_id, part, tokens (little-endian uint16) of the slots from start to stop, in order within a shard.

    Shards without a slot in that range aren't opened; a manifest without shards gives an empty result.
    """
    uri = uri if "://" in uri else f"file://{uri}"
    m, rows, first = manifest_of(uri), [], 0
    for shard, n, _ in m["shards"]:
        a, b = max(start - first, 0), min(n, n if stop is None else stop - first)
        if a < b:
            rows.append((shard, first, a, b))
        first += n
    todo = spark.createDataFrame(rows, "shard long, first long, start long, stop long").repartition(max(1, min(len(rows), MOST_TASKS)))
    return todo.mapInPandas(partial(_read, uri=uri, stride=m["stride"]), "slot long, shard long, offset long, doc_id long, part int, tokens binary")


def shard_digest(docs: DataFrame) -> DataFrame:
    """slot, shard, offset, doc_id, part, n_tokens, tokens_crc32 of each record, read back from the shards of docs."""
    back = read_shards(docs.sparkSession, materialise(docs))
    return back.select("slot", "shard", "offset", "doc_id", "part", (F.octet_length("tokens") / 2).cast("long").alias("n_tokens"), F.crc32("tokens").alias("tokens_crc32"))
