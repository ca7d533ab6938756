"""BAM files as DataFrames, read in splits.

A BAM file is a chain of small compressed blocks (BGZF), and records go from one into the next. A file is dealt into splits of SPLIT
compressed bytes. The task of a split finds the first block that begins in it by its header, and guesses the first record in there by
what a chain of records must look like. All splits are first walked by record sizes alone; the place where one split's records end must
be the place where the next one's begin. A guess that doesn't fit is replaced by that place, so what is read doesn't depend on guesses.

Splits are read through Arrow's file systems (local, HDFS, S3, GCS). Files of a store that only Spark reads are taken whole, as binary
rows, each under 2 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes of a split; records of a batch.
SPLIT, BATCH = 32 << 20, 2000
SCHEMA = "read_name string, flags int, chr string, pos int, mapq int, cigar string, seq string, quals array<int>, ec float, np int, rq float"
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_KINDS = {"np": "cCsSiI", "ec": "f", "rq": "f"}
_MOST = 1 << 28
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(data: bytes, at: int, end: int) -> dict:
    out: dict = {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if name in _KINDS and kind in "ZHB":
            raise ValueError(f"tag {name} of another type than expected: {kind}")
        if kind in "ZH":
            stop = data.index(b"\0", at)
            at = stop + 1
        elif kind == "B":
            n = struct.unpack_from("<I", data, at + 1)[0]
            if name == "CG" and chr(data[at]) == "I":
                out[name] = struct.unpack_from(f"<{n}I", data, at + 5)
            at += 5 + _SIZES[chr(data[at])] * n
        else:
            if name in _KINDS and kind not in _KINDS[name]:
                raise ValueError(f"tag {name} of another type than expected: {kind}")
            if kind in _CODES:
                out[name] = struct.unpack_from("<" + _CODES[kind], data, at)[0]
            at += _SIZES[kind]
    return out


class Names:
    """Names of references by their numbers, as bytes and ends, so that millions of them are no load."""

    def __init__(self, text: bytes, ends: np.ndarray):
        self.text, self.ends = text, ends

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, k: int) -> str:
        return self.text[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].decode()


def _header(b: Blocks) -> tuple[Names, int]:
    """(names of the references, where the records begin) of a file's blocks from its first one on. Each byte is gone through once."""

    def number(at: int) -> int:
        if not b.has(at + 4):
            raise ValueError("not a BAM file: the header goes on")
        return struct.unpack_from("<i", b.data, at)[0]

    if not b.has(8) or b.data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    n, text, ends = number(at), bytearray(), []
    at += 4
    for _ in range(n):
        size = number(at)
        if not b.has(at + 8 + size):
            raise ValueError("not a BAM file: the header goes on")
        text += b.data[at + 4 : at + 3 + size]
        ends.append(len(text))
        at += 8 + size
    return Names(bytes(text), np.array(ends, np.int64)), at


def record(data, at: int, names: Sequence[str]) -> tuple[tuple, int]:
    """(a record in SCHEMA's order, where it ends). A CIGAR too long for its field, which then clips all bases, stands in tag CG."""
    end = at + 4 + struct.unpack_from("<i", data, at)[0]
    ref, pos, name_size, mapq, _, n_ops, flags, n_bases = struct.unpack_from("<iiBBHHHi", data, at + 4)
    p = at + 36
    name = bytes(data[p : p + name_size - 1]).decode()
    p += name_size
    ops = struct.unpack_from(f"<{n_ops}I", data, p)
    p += 4 * n_ops
    packed = bytes(data[p : p + (n_bases + 1) // 2])
    seq = "".join(map(_PAIRS.__getitem__, packed))[:n_bases]
    p += len(packed)
    quals = bytes(data[p : p + n_bases])
    tags = _tags(bytes(data[p + n_bases : end]), 0, end - p - n_bases)
    if n_ops == 2 and ops[0] == n_bases << 4 | _OPS.index("S") and ops[1] & 15 == _OPS.index("N"):
        ops = tags.get("CG", ops)
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*"
    row = name, flags, names[ref] if ref >= 0 else None, pos + 1, None if mapq == 255 else mapq, cigar, seq, [] if quals.count(255) == len(quals) else list(quals), tags.get("ec"), tags.get("np"), tags.get("rq")
    return row, end


class Blocks:
    """The blocks of a file from one that begins at a place on; data: what of them is decompressed, and at: where each begins in it."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.next = file, size, start
        self.data, self.at = bytearray(), []

    def more(self) -> bool:
        """Decompress the next block."""
        if self.next >= self.size:
            return False
        head = self.file.read_at(min(65536 + 64, self.size - self.next), self.next)
        size = block_size(head, 0)
        if size is None:
            raise ValueError(f"no block at byte {self.next}")
        extra = struct.unpack_from("<H", head, 10)[0]
        self.at.append((self.next, len(self.data)))
        self.data += zlib.decompress(head[12 + extra : size - 8], -15)
        self.next += size
        return True

    def has(self, n: int) -> bool:
        """Whether the data goes on to its n-th byte; blocks are read until it does."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def place(self, at: int) -> tuple[int, int]:
        """(block, byte in it) of a place in the data; the end of a block is the beginning of the next."""
        for start, first in reversed(self.at):
            if at >= first:
                if at == len(self.data):
                    return self.next, 0
                return start, at - first
        return self.next, 0


def block_size(head: bytes, at: int) -> int | None:
    """The size of the block whose header is at a place; None if it is no header."""
    if head[at : at + 4] != b"\x1f\x8b\x08\x04" or at + 12 > len(head):
        return None
    end = at + 12 + struct.unpack_from("<H", head, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def first_block(file, size: int, start: int) -> int:
    """The first block that begins at start or later; the file's end without one. Two headers in a row, or one and the end, are a block."""
    at = start
    while at < size:
        window = file.read_at(min(1 << 18, size - at), at)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0 and i + 18 <= len(window):
            n = block_size(window, i)
            if n is not None and (at + i + n == size or block_size(file.read_at(min(64, size - at - i - n), at + i + n), 0) is not None):
                return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(window) - 18)
    return size


def _plausible(b: Blocks, at: int, n_refs: int) -> int | None:
    """Where the record at a place would end; None if there can't be one."""
    if not b.has(at + 36):
        return None
    size, ref, pos, name_size, _, _, n_ops, _, n_bases, other, other_pos = struct.unpack_from("<iiiBBHHHiii", b.data, at)
    least = 32 + name_size + 4 * n_ops + (n_bases + 1) // 2 + n_bases
    if not (name_size and 0 <= n_bases and least <= size < _MOST and -1 <= ref < n_refs and -1 <= other < n_refs and pos >= -1 and other_pos >= -1):
        return None
    if not b.has(at + 36 + name_size) or b.data[at + 35 + name_size] or 0 in b.data[at + 36 : at + 35 + name_size]:
        return None
    return at + 4 + size


def guess(b: Blocks, n_refs: int, chain: int = 8) -> int:
    """The first place from which a chain of plausible records goes on (or to the file's end)."""
    at = 0
    while b.has(at + 4):
        end, k = at, 0
        while k < chain and (after := _plausible(b, end, n_refs)) is not None:
            end, k = after, k + 1
            if not b.has(end + 4):
                break
        if k == chain or k and not b.has(end + 4) and b.has(end):
            return at
        at += 1
    return len(b.data)


def _opened(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _begun(file, size: int, start: int, n_refs: int, exact: tuple[int, int] | None) -> tuple[Blocks, int]:
    """(blocks, the place in their data) from which the records of a split are read."""
    if exact is not None:
        b = Blocks(file, size, exact[0])
        b.has(exact[1] + 1)
        return b, exact[1]
    b = Blocks(file, size, first_block(file, size, start) if start else 0)
    return (b, guess(b, n_refs)) if start else (b, _header(b)[1])


def _walk(b: Blocks, at: int, stop: int) -> Iterator[int]:
    """The places of the records that begin in blocks before stop."""
    while b.has(at + 4) and b.place(at)[0] < stop:
        end = at + 4 + struct.unpack_from("<i", b.data, at)[0]
        if not b.has(end):
            raise ValueError("the file ends within a record")
        yield at
        at = end
        if at > 1 << 22:  # what is behind isn't needed any more
            keep = max(i for i, (_, first) in enumerate(b.at) if first <= at) if at < len(b.data) else len(b.at)
            gone = b.at[keep][1] if keep < len(b.at) else len(b.data)
            del b.data[:gone]
            b.at = [(start, first - gone) for start, first in b.at[keep:]]
            at -= gone
    yield -1 - at


_ENDS = pa.schema([("path", pa.string()), ("start", pa.int64()), *[(c, pa.int64()) for c in ("first_block", "first_byte", "next_block", "next_byte")]])


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the records of each split begin and where those of the next must."""
    for r in _split_rows(batches):
        with _opened(r["path"]) as file:
            exact = None if r["block"] is None else (r["block"], r["byte"])
            b, at = _begun(file, r["size"], r["start"], r["n_refs"], exact)
            first = b.place(at)
            for at in _walk(b, at, r["stop"]):
                pass
            after = b.place(-1 - at)
        yield pa.RecordBatch.from_pylist([{"path": r["path"], "start": r["start"], "first_block": first[0], "first_byte": first[1], "next_block": after[0], "next_byte": after[1]}], _ENDS)


def _shape() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "float": pa.float32(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    shape, some = _shape(), []
    for r in rows:
        some.append(r)
        if len(some) >= BATCH or sum(map(len, (r[6], r[7]))) > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), shape, strict=True)], schema=shape)


def _decoded(batches: Iterator[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for r in _split_rows(batches):
            with _opened(r["path"]) as file:
                b, at = _begun(file, r["size"], r["start"], r["n_refs"], (r["block"], r["byte"]))
                for at in _walk(b, at, r["stop"]):
                    if at >= 0:
                        yield record(b.data, at, names.value[r["path"]])[0]

    yield from _batches(rows())


class _Held:
    """A file that is held whole."""

    def __init__(self, content: bytes):
        self.content = content

    def read_at(self, n: int, at: int) -> bytes:
        return self.content[at : at + n]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(len(batch)):
                content = batch["content"][k].as_py()
                names, at = _header(b := Blocks(_Held(content), len(content), 0))
                for at in _walk(b, at, len(content) + 1):
                    if at >= 0:
                        yield record(b.data, at, names)[0]

    yield from _batches(rows())


def _heads(files: list[tuple[str, int]]) -> tuple[dict[str, Names], dict[str, tuple[int, int]]]:
    """(names of the references, place of the first record) by file. Equal lists of names are held once."""
    names, firsts, held = {}, {}, {}
    for path, size in files:
        with _opened(path) as file:
            mine, at = _header(b := Blocks(file, size, 0))
            b.has(at + 1)
        names[path] = held.setdefault((hashlib.sha256(mine.text).digest(), mine.ends.tobytes()), mine)
        firsts[path] = b.place(at)
    return names, firsts


def _tasks(spark: SparkSession, splits: list[tuple]) -> int:
    """So many tasks go through splits: of SPLIT bytes each, but some for every core; never more than splits."""
    total = sum(x[4] - x[3] for x in splits)
    return max(1, min(len(splits), max(-(-total // SPLIT), 4 * spark.sparkContext.defaultParallelism)))


def bam(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Alignments of BAM files in SCHEMA, and aln_id. split: compressed bytes of a split (SPLIT if None)."""
    split = split or SPLIT
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    files = [(f"file://{p[5:]}" if p.startswith("file:/") and not p.startswith("file://") else p, n) for p, n in files]
    try:
        names, firsts = _heads(files)
    except (pa.ArrowException, OSError, ValueError) as e:
        if "BAM" in str(e) or "block" in str(e):
            raise
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_whole, SCHEMA).withColumn("aln_id", F.monotonically_increasing_id())
    shape = "path string, size long, n_refs int, start long, stop long, block long, byte long"
    # Splits that lie in a header have no records; the one in which the first record begins is read from there.
    starts = {p: range(min(firsts[p][0], n - 1) // split * split, n, split) for p, n in files}
    exact = {(p, starts[p][0]): firsts[p] for p, _ in files}
    splits = [(p, n, len(names[p]), a, min(a + split, n), None, None) for p, n in files for a in starts[p]]
    todo, ends = splits, {}
    while todo:
        frame = spark.createDataFrame([(*x[:5], *exact.get((x[0], x[3]), (None, None))) for x in todo], shape).repartition(_tasks(spark, todo))
        ends |= {(r["path"], r["start"]): r for r in frame.mapInArrow(_ends, "path string, start long, first_block long, first_byte long, next_block long, next_byte long").collect()}
        todo = []
        for p, n in files:
            due = None
            for a in starts[p]:
                r = ends[p, a]
                if due is not None and (r["first_block"], r["first_byte"]) != due:
                    exact[p, a] = due
                    todo.append((p, n, len(names[p]), a, min(a + split, n), None, None))
                    break  # what follows depends on this one
                due = (r["next_block"], r["next_byte"])
    known = [(*x[:5], ends[x[0], x[3]]["first_block"], ends[x[0], x[3]]["first_byte"]) for x in splits]
    frame = spark.createDataFrame(known, shape).repartition(_tasks(spark, known))
    return frame.mapInArrow(partial(_decoded, names=spark.sparkContext.broadcast(names)), SCHEMA).withColumn("aln_id", F.monotonically_increasing_id())
