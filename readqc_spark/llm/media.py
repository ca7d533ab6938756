"""Telephony audio columns: text bytes kept as G.711 samples in WAV files, expanded, ADPCM-decoded and resampled.

A payload is a text's UTF-8 bytes, padded with 255 to a positive multiple of one ADPCM block. It is stored as 8-bit mu-law
samples in a WAV container, one media row for each row of docs, in a Parquet table in the shared folder; what follows reads that
table. The stored bytes can be heard as mu-law, as A-law and as 4-bit IMA ADPCM blocks of 576 bytes; the first two are table
lookups, the third is decoded with numpy one step at a time across all blocks of a slice of rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import batches_of, shared_dir, texts

BLOCK, RATE, PAD = 576, 8000, b"\xff"
MU_LAW, A_LAW = 7, 6
# Fixed values of the IMA ADPCM format: step sizes, and index moves by the low three bits of a code.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, low + 8, low + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    step, code = np.array(STEPS, np.int32)[:, None], np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    onward = np.clip(np.arange(89)[:, None] + np.array(MOVES)[code & 7], 0, 88) * 16
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), onward.astype(np.int32).ravel()


MU, A = mu_law_table(), a_law_table()
_CHANGE, _ONWARD = _adpcm_tables()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (blocks, 1145) of uint8 blocks (blocks, 576): four header bytes, then codes, low half first."""
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    at = np.minimum(head[:, 2], 88) * 16
    codes = np.empty((2 * (BLOCK - 4), len(blocks)), np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        at = at + code
        value = value + _CHANGE[at]
        np.clip(value, -32768, 32767, out=value)
        at = _ONWARD[at]
        out[k + 1] = value
    return out.T


def upsample(x: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the half-way value by the weights -1 9 9 -1 (sixteenths); ends repeat the outer sample."""
    y = np.pad(x.astype(np.int32), (1, 2), "edge")
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip((9 * (y[1:-2] + y[2:-1]) - y[:-3] - y[3:] + 8) >> 4, -32768, 32767)
    return out


def wav(samples: bytes, kind: int = MU_LAW, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit G.711 samples: fmt, fact and data chunks."""
    odd = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, kind, 1, rate, rate, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(samples)) + b"data" + struct.pack("<I", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, bytes]:
    """(format, rate, samples) of a WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", data, at + 8)
        if name == b"data":
            return kind, rate, bytes(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for some in batches_of(f["text"]):
            raw = [b for _, b in some]
            yield pd.DataFrame({"doc_id": f["doc_id"].iloc[[i for i, _ in some]].to_numpy(), "n_bytes": [len(b) for b in raw], "media": [wav(b + PAD * ((-len(b)) % BLOCK if b else BLOCK)) for b in raw]})


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    square = {name: (t.astype(np.int64) ** 2) for name, t in (("mu", MU), ("a", A))}
    for f in frames:
        at = 0
        while at < len(f):
            end, size = at, 0
            while end < len(f) and (end == at or size + len(f["media"].iloc[end]) <= 4 << 20):
                size += len(f["media"].iloc[end])
                end += 1
            part, rows = f.iloc[at:end], []
            at = end
            loads = [read_wav(x)[2] for x in part["media"]]
            blocks = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, BLOCK)
            heard = np.empty((len(blocks), 3), np.int64)
            for i in range(0, len(blocks), 8192):
                got = adpcm_decode(blocks[i : i + 8192])
                wide = got.astype(np.int64)
                heard[i : i + 8192] = np.stack([np.abs(wide).sum(1), np.abs(wide).max(1), ((got[:, 1:] ^ got[:, :-1]) < 0).sum(1)], 1)
            first = np.concatenate([[0], np.cumsum([len(x) // BLOCK for x in loads])])
            total, peak = np.add.reduceat(heard, first[:-1]), np.maximum.reduceat(heard[:, 1], first[:-1])
            for k, (n, media, load) in enumerate(zip(part["n_bytes"], part["media"], loads, strict=True)):
                samples = np.frombuffer(load, np.uint8)
                hist = np.bincount(samples, minlength=256)
                level = [int((hist * square[x]).sum()) // len(load) for x in ("mu", "a")]
                feature = f"mu_power={level[0]};a_power={level[1]};adpcm_mean={int(total[k, 0]) // (2 * len(load))};adpcm_peak={int(peak[k])};adpcm_crossings={int(total[k, 2])}"
                rows.append((int(n), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, upsample(MU[samples]).tobytes()))
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])], axis=1)


def store_media(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media of docs (doc_id, text), written to path (a new folder in the shared one if None) and read back.

    Null texts count as empty; an empty text is one block of padding. Repeated rows each get their row, very long texts one sample for
    each byte. An empty table gives an empty one; other columns aren't looked at.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    texts(docs).mapInPandas(_pack, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def media_columns(media: DataFrame) -> DataFrame:
    """Digests and features of a table of stored media, and pcm: the samples at twice the rate, 16 bits, little-endian.

    A row for each row of media; an empty table gives an empty result.
    """
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")


PCM = "doc_id long, codec string, rate int, pcm binary"


def _expanded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for doc, media in zip(f["doc_id"], f["media"], strict=True):
            _, rate, load = read_wav(media)
            samples = np.frombuffer(load, np.uint8)
            heard = (("mu", MU[samples]), ("a", A[samples]), ("adpcm", adpcm_decode(samples.reshape(-1, BLOCK)).ravel()))
            yield pd.DataFrame([(doc, codec, 2 * rate, upsample(x).tobytes()) for codec, x in heard], columns=[x.split()[0] for x in PCM.split(", ")])


def store_pcm(media: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, codec (mu, a, adpcm), rate, pcm of a table of stored media: 16-bit little-endian samples at twice the rate.

    Written to path (a new folder in the shared one if None) and read back. Some sixteen bytes are stored for each byte of a text. Null
    ids and repeated rows each get their three rows; an empty table gives an empty one.
    """
    spark = media.sparkSession
    path = path or f"{shared_dir(spark)}/pcm-{uuid.uuid4().hex}"
    media.select("doc_id", "media").mapInPandas(_expanded, PCM).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def media_digest(docs: DataFrame) -> DataFrame:
    """The columns of media_columns for each row of docs, with pcm's size and SHA-256 in its place."""
    return media_columns(store_media(docs)).withColumn("pcm_bytes", F.length("pcm").cast("long")).withColumn("pcm_sha256", F.sha2("pcm", 256)).drop("pcm")
