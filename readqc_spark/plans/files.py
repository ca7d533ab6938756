"""Files in the formats that the sources read, written by the tasks: what the queries over files, and tests, read back."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator, Mapping
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_EMPTY = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # the empty block that ends a file


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; a temporary one in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="files-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _text(lines: DataFrame, name: str, compression: str = "none") -> str:
    path = folder(lines.sparkSession, name)
    lines.write.option("compression", compression).text(path)
    return path


def fasta(contigs: DataFrame, compression: str = "none") -> str:
    """FASTA with descriptions, bases in lower case and lines of 60."""
    body = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    return _text(contigs.select(F.concat(F.lit(">"), "chr", F.lit(" a > b\n"), body).alias("value")), "fasta", compression)


def bed(rows: DataFrame) -> str:
    return _text(rows.select(F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), (F.col("stop") - 1).cast("string"), "feature").alias("value")), "bed")


def sam(alignments: DataFrame) -> str:
    quals = F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")
    tag = lambda c, kind: F.concat(F.lit(f"{c}:{kind}:"), F.col(c).cast("string"))
    fields = ["read_name", F.col("flags").cast("string"), "chr", F.col("pos").cast("string"), F.coalesce("mapq", F.lit(255)).cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", quals, tag("ec", "f"), tag("np", "i"), tag("rq", "f")]
    return _text(alignments.select(F.concat_ws("\t", *fields).alias("value")), "sam")


def block(data: bytes) -> bytes:
    """A BGZF block."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(r: dict, numbers: Mapping[str, int]) -> bytes:
    """A BAM record of an alignment; a CIGAR of more operations than fit goes to tag CG."""
    cigar = [(int(n), _OPS.index(op)) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", r["cigar"] or "")]
    name, seq = r["read_name"].encode() + b"\0", r["seq"] or ""
    codes = [_BASES.index(x) for x in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    quals = bytes(r["quals"]) if r["quals"] else b"\xff" * len(seq)
    tags = b"XXZtext\0XBBC\x02\0\0\0\x01\x02" + b"".join(t + struct.pack(f, r[k]) for k, t, f in (("ec", b"ecf", "<f"), ("np", b"npC", "<B"), ("rq", b"rqf", "<f")) if r[k] is not None)
    if len(cigar) > 65535:
        tags += b"CGBI" + struct.pack(f"<I{len(cigar)}I", len(cigar), *[n << 4 | op for n, op in cigar])
        cigar = [(len(seq), _OPS.index("S")), (sum(n for n, op in cigar if _OPS[op] in "MDN=X"), _OPS.index("N"))]
    core = struct.pack("<iiBBHHHiiii", numbers.get(r["chr"], -1), r["pos"] - 1, len(name), 255 if r["mapq"] is None else r["mapq"], 0, len(cigar), r["flags"], len(seq), -1, -1, 0)
    body = core + name + struct.pack(f"<{len(cigar)}I", *[n << 4 | op for n, op in cigar]) + packed + quals + tags
    return struct.pack("<i", len(body)) + body


def bam_bytes(rows: Iterator[dict], names: Iterable[tuple[str, int]], size: int = 20_000, numbers: Mapping[str, int] | None = None) -> Iterator[bytes]:
    """The blocks of a BAM file, of size bytes each before compression, wherever records end. numbers: the place of each name in names."""
    head = b"@HD\tVN:1.6\n"
    out = bytearray(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(names)))
    for name, n in names:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    numbers = {name: k for k, (name, _) in enumerate(names)} if numbers is None else numbers
    for r in rows:
        out += record(r, numbers)
        while len(out) >= size:
            yield block(bytes(out[:size]))
            del out[:size]
    yield block(bytes(out)) + _EMPTY


class _Sorted:
    """References in the order of their names, as arrays: (name, length) pairs, and a name's place by binary search."""

    def __init__(self, table: pa.Table):
        names = np.array([x.encode() for x in table["chr"].to_pylist()], np.bytes_)
        order = np.argsort(names)
        self.names, self.lengths = names[order], table["length"].to_numpy()[order]

    def __len__(self) -> int:
        return len(self.names)

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return ((name.decode(), n) for name, n in zip(self.names, self.lengths.tolist(), strict=True))

    def get(self, name: str | None, missing: int) -> int:
        key = b"" if name is None else name.encode()
        if not 0 < len(key) <= self.names.itemsize:  # a longer one would have all names copied
            return missing
        k = int(np.searchsorted(self.names, key))
        return k if k < len(self.names) and self.names[k] == key else missing


def _written(batches: Iterator[pa.RecordBatch], path: str, names) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for some in range(0, len(b), 1000) for r in b.slice(some, 1000).to_pylist())
    if (first := next(rows, None)) is not None:
        store, name = fs.FileSystem.from_uri(f"{path}/{uuid.uuid4().hex}.bam")
        with store.open_output_stream(name) as f:
            for part in bam_bytes(chain([first], rows), names.value, numbers=names.value):
                f.write(part)
        yield pa.RecordBatch.from_pydict({"path": [name]})


def bam(alignments: DataFrame, contigs: DataFrame) -> str:
    """A folder of BAM files, one for each of a few partitions of alignments: each has all contigs in its header, so their number is bounded."""
    spark = alignments.sparkSession
    path = folder(spark, "bam")
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name, recursive=True)
    names = _Sorted(contigs.select("chr", "length").toArrow())
    tasks = min(max(4, spark.sparkContext.defaultParallelism), 16)
    alignments.repartition(tasks).mapInArrow(partial(_written, path=path, names=spark.sparkContext.broadcast(names)), "path string").collect()
    return path
