"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

A text of at most CHUNK characters is encoded whole by the library. A longer one is split into chunks at fixed places, also within
words. The state at a boundary is the last piece that begins before it. Each chunk yields a max-plus matrix from the states at its left
boundary to those at its right one: the weight of the best path of pieces between them, minus infinity without one. Matrices are
combined associatively (within blocks of chunks, then over blocks), forward and backward, which settles the state at every boundary; each
chunk is then backtraced on its own. For BPE a path's weight is 0 if all its neighbouring pieces are compatible, that is, if encoding
the two together gives the two again; the path of which that holds everywhere is the one that BPE finds. No piece of these
vocabularies goes from a word into the next, so within a chunk only the parts before the first and after the last word's beginning depend
on the states.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import cut, parts_of, repeated, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, LEAST, PER_BLOCK = 32768, 64, 64
SPACE = "▁"
_HARD = re.compile(f"(?<=[^{SPACE}]){SPACE}")
OUT = "doc_id long, chunk int, n_chunks int, ids array<int>"
TOLD = ", n_tokens long, ids_crc32 long, n_chars long, text_sha256 string"


class Pieces:
    """A BPE SentencePiece model with identity normalisation and byte fallback."""

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.ids = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: self.sp.get_score(i) for i in plain}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        if len(self.byte) != 256 or any(_HARD.search(p) for p in self.ids):
            raise ValueError("the model needs byte fallback and pieces within words")
        if self.sp.encode(" a  b") != self.sp.encode(f"{SPACE}a{SPACE}{SPACE}b"):
            raise ValueError("the model normalises its input")
        self._fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str | None, b: str) -> bool:
        key = (a or "", b)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 20_000:
                self._fits.clear()
            found = self._fits[key] = self.merged(key[0] + b) == ([a, b] if a else [b])
        return found

    def after(self, text: str, at: int) -> Iterator[str]:
        """Pieces that can begin at a place; a character without a piece stands for its bytes."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            p = text[at : at + n]
            if n == 1 or p in self.ids:
                yield p

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(characters before, characters from the boundary on) of the pieces that begin before it and reach it, in fixed order."""
        out = []
        for back in range(1, min(self.longest, at) + 1):
            for over in range(0, min(self.longest - back, len(text) - at) + 1):
                if back + over == 1 or text[at - back : at + over] in self.ids:
                    out.append((back, over))
        return out

    def paths(self, text: str, at: int, last: str | None, end: int) -> dict[int, dict[str, tuple[float, int, str | None]]]:
        """place -> piece that ends there -> (weight, where the piece before ends, that piece), for paths from a place and a piece to end."""
        seen: dict[int, dict[str, tuple[float, int, str | None]]] = {at: {last or "": (0.0, -1, None)}}
        for here in range(at, end):
            for prior, (weight, _, _) in list(seen.get(here, {}).items()):
                for p in self.after(text, here):
                    if self.fits(prior or None, p):
                        there = seen.setdefault(here + len(p), {})
                        if p not in there or there[p][0] < weight:
                            there[p] = (weight, here, prior or None)
        return seen

    def trace(self, seen, at: int, place: int, piece: str) -> list[str]:
        out = []
        while place > at:
            out.append(piece)
            _, place, piece = seen[place][piece]
        return out[::-1]

    def to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out.extend(self.byte[b] for b in p.encode("utf-8", "surrogatepass"))
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of a normalised string that begins a word, or is empty."""
        return self.sp.encode(text[1:].replace(SPACE, " ")) if len(text) > 1 else self.to_ids(list(text))

    def text(self, ids, first: bool) -> str:
        """The text of ids; first: they begin a document, whose leading space isn't of the text."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.piece[i])
        out.append(raw.decode("utf-8", "replace"))
        joined = "".join(out).replace(SPACE, " ")
        return joined[1:] if first else joined


_loaded: dict[int, Pieces] = {}


def loaded(proto) -> Pieces:
    """The model of a broadcast, made once in each worker."""
    key = hash(proto.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto.value)
    return _loaded[key]


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunk_places(n: int, chunk: int = CHUNK) -> list[int]:
    """Boundaries 0 to n of a normalised text of n characters; no chunk but a lone one has fewer than LEAST."""
    places = list(range(0, n, chunk))
    if len(places) > 1 and n - places[-1] < LEAST:
        places.pop()
    return [*places, n]


#: What the steps of the scan pass on, as Spark and as Arrow name it.
PARTS = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string())])
MATRICES = pa.schema([("key", pa.string()), ("block", pa.int32()), ("chunk", pa.int32()), ("n_into", pa.int32()), ("cells", pa.list_(pa.float64()))])
PRODUCTS = MATRICES.remove(2)
AROUND = pa.schema([("key", pa.string()), ("block", pa.int32()), ("ahead", pa.list_(pa.float64())), ("behind", pa.list_(pa.float64()))])
STATES = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("into", pa.int32()), ("out", pa.int32())])
TRACED = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(len(b)):
            yield b.slice(k, 1).to_pylist()[0]


def _split(batches: Iterator[pa.RecordBatch], longest: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        text = normal(r["text"])
        places = chunk_places(len(text), chunk)
        for k, (a, b) in enumerate(zip(places, places[1:], strict=False)):
            yield pa.RecordBatch.from_pylist([{"key": r["key"], "chunk": k, "n_chunks": len(places) - 1, "left": text[max(0, a - longest) : a], "body": text[a:b], "right": text[b : b + longest]}], PARTS)


def _frame(m: Pieces, left: str, body: str, right: str):
    """The text around a chunk, its boundaries there, the states at both, and the first and last word's beginnings inside."""
    text, a, b = left + body + right, len(left), len(left) + len(body)
    into = m.states(text, a) if left else [(0, 0)]
    hard = [x.start() for x in _HARD.finditer(text, max(a, 1), b) if a <= x.start() < b]
    if not left:
        hard.insert(0, 0)
    return text, a, b, into, m.states(text, b), hard


def matrix(m: Pieces, left: str, body: str, right: str) -> np.ndarray:
    """Max-plus matrix of a chunk, (states at its left, states at its right)."""
    text, a, b, into, out, hard = _frame(m, left, body, right)
    got = np.full((len(into), len(out)), -np.inf)
    ends = {(text[b - back : b + over], b + over): k for k, (back, over) in enumerate(out)}

    def leaving(at: int, last: str | None) -> np.ndarray:
        row = np.full(len(out), -np.inf)
        for place, pieces in m.paths(text, at, last, b).items():
            for p, (weight, _, _) in pieces.items():
                if (k := ends.get((p, place))) is not None and place - len(p) < b:
                    row[k] = max(row[k], weight)
        return row

    tail = leaving(hard[-1], None) if hard else None
    for i, (back, over) in enumerate(into):
        at, last = a + over, text[a - back : a + over] or None
        if hard and at <= hard[0]:
            reach = m.paths(text, at, last, hard[0]).get(hard[0])
            if reach:
                got[i] = max(w for w, _, _ in reach.values()) + tail
        elif not hard:
            got[i] = leaving(at, last)
    return got


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x[:, :, None] + y[None, :, :]).max(1) if x.size and y.size else np.full((x.shape[0], y.shape[1]), -np.inf)


def _matrices(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = loaded(model)
    for r in _rows(batches):
        got = matrix(m, r["left"], r["body"], r["right"])
        yield pa.RecordBatch.from_pylist([{"key": r["key"], "block": r["chunk"] // PER_BLOCK, "chunk": r["chunk"], "n_into": got.shape[0], "cells": got.ravel()}], MATRICES)


def _shaped(r: dict) -> np.ndarray:
    return np.asarray(r["cells"], float).reshape(r["n_into"], -1)


def _product(t: pa.Table) -> pa.Table:
    total = None
    for r in t.sort_by("chunk").to_pylist():
        total = _shaped(r) if total is None else times(total, _shaped(r))
    return pa.Table.from_pylist([{"key": r["key"], "block": r["block"], "n_into": total.shape[0], "cells": total.ravel()}], PRODUCTS)


def _both_ways(matrices: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Best weights up to each boundary, and from each boundary on."""
    up, down = [ahead], [behind]
    for x in matrices:
        up.append(times(up[-1][None, :], x)[0])
    for x in reversed(matrices):
        down.append(times(x, down[-1][:, None])[:, 0])
    return up, down[::-1]


def _over_blocks(t: pa.Table) -> pa.Table:
    rows = t.sort_by("block").to_pylist()
    each = [_shaped(r) for r in rows]
    up, down = _both_ways(each, np.zeros(each[0].shape[0]), np.zeros(each[-1].shape[1]))
    return pa.Table.from_pylist([{"key": r["key"], "block": r["block"], "ahead": a, "behind": b} for r, a, b in zip(rows, up, down[1:], strict=False)], AROUND)


def _within_block(chunks: pa.Table, block: pa.Table) -> pa.Table:
    rows, ends = chunks.sort_by("chunk").to_pylist(), block.to_pylist()
    if not rows:
        return STATES.empty_table()
    up, down = _both_ways([_shaped(r) for r in rows], np.asarray(ends[0]["ahead"], float), np.asarray(ends[0]["behind"], float))
    best = [u + d for u, d in zip(up, down, strict=True)]
    if not all(len(x) and np.isfinite(x.max()) for x in best):
        raise RuntimeError("no path of pieces leads through this text")
    at = [int(np.argmax(x)) for x in best]
    return pa.Table.from_pylist([{"key": r["key"], "chunk": r["chunk"], "into": a, "out": b} for r, a, b in zip(rows, at, at[1:], strict=False)], STATES)


def _backtraced(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = loaded(model)
    for r in _rows(batches):
        text, a, b, into, out, hard = _frame(m, r["left"], r["body"], r["right"])
        (back, over), (back2, over2) = into[r["into"]], out[r["out"]]
        at, last, end, final = a + over, text[a - back : a + over] or None, b + over2, text[b - back2 : b + over2]
        ids: list[int] = []
        if hard:
            seen = m.paths(text, at, last, hard[0])
            if hard[0] > at:
                ids += m.to_ids(m.trace(seen, at, hard[0], max(seen[hard[0]], key=lambda p: seen[hard[0]][p][0])))
            if hard[-1] > hard[0]:
                ids += m.whole(text[hard[0] : hard[-1]])
            at, last = hard[-1], None
        ids += m.to_ids(m.trace(m.paths(text, at, last, b), at, end, final))
        yield pa.RecordBatch.from_pylist([{"key": r["key"], "chunk": r["chunk"], "n_chunks": r["n_chunks"], "ids": ids}], TRACED)


def _lists(values: list) -> pa.Array:
    """An array of lists of int32, from lists or arrays of numbers."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in values]) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _told(ids: list, texts_: list[str]) -> list[pa.Array]:
    """The columns of TOLD."""
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts_]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array([_crc(x) for x in ids], pa.int64()), pa.array([len(t) for t in texts_], pa.int64()), pa.array(digest, pa.string())]


def _encoded(batches: Iterator[pa.RecordBatch], model, back: bool) -> Iterator[pa.RecordBatch]:
    """Texts encoded whole; back: decoded again, too."""
    m, names = loaded(model), [x.split()[0] for x in (OUT + TOLD * back).split(", ")]
    for b in batches:
        for some in parts_of(b["text"], 1 << 19):
            ids, n = m.sp.encode([t.decode("utf-8", "replace") for _, t in some], num_threads=1), len(some)
            columns = [b["doc_id"].slice(some[0][0], n), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32)), _lists(ids)]
            yield pa.RecordBatch.from_arrays(columns + (_told(ids, m.sp.decode(ids, num_threads=1)) if back else []), names)


def _crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<i4").tobytes())


def _texts(m: Pieces, ids: list[list[int]], chunk: list[int], n_chunks: list[int]) -> list[str]:
    """The text of each list of ids."""
    return [m.sp.decode(x) if n == 1 else m.text(x, c == 0) for x, c, n in zip(ids, chunk, n_chunks, strict=True)]


def _decoded(batches: Iterator[pa.RecordBatch], model, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of encode's result with their texts, or with what TOLD says of them."""
    m = loaded(model)
    for b in batches:
        for k in range(0, len(b), 100):
            some = b.slice(k, 100)
            ids = some["ids"].to_pylist()
            found, keys = _texts(m, ids, some["chunk"].to_pylist(), some["n_chunks"].to_pylist()), [some[c] for c in ("doc_id", "chunk", "n_chunks")]
            if digest:
                names = [x.split()[0] for x in (OUT + TOLD).split(", ")]
                yield pa.RecordBatch.from_arrays([*keys, some["ids"], *_told(ids, found)], names)
            else:
                n, crc, _, _ = _told(ids, found)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.string()), n, crc], ["doc_id", "chunk", "n_chunks", "text", "n_tokens", "ids_crc32"])


def _giants(text: DataFrame, proto, chunk: int) -> DataFrame:
    """OUT for the texts of more than chunk characters, by the parallel scan."""
    giant = text.filter(F.length("text") > chunk).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "text"), 256))
    giant = cut(giant)
    names = giant.select("key", "doc_id", "times")
    parts = giant.select("key", "text").mapInArrow(partial(_split, longest=loaded(proto).longest, chunk=chunk), "key string, chunk int, n_chunks int, left string, body string, right string")
    # By number, so that adaptive execution doesn't put chunks together by their bytes: a chunk costs far more than its bytes do.
    parts = cut(parts.repartition(max(int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "key", "chunk"))
    each = cut(parts.mapInArrow(partial(_matrices, model=proto), "key string, block int, chunk int, n_into int, cells array<double>"))
    blocks = each.groupBy("key", "block").applyInArrow(_product, "key string, block int, n_into int, cells array<double>")
    around = blocks.groupBy("key").applyInArrow(_over_blocks, "key string, block int, ahead array<double>, behind array<double>")
    at = each.groupBy("key", "block").cogroup(around.groupBy("key", "block")).applyInArrow(_within_block, "key string, chunk int, into int, out int")
    traced = parts.join(F.broadcast(at) if _few(each) else at, ["key", "chunk"]).mapInArrow(partial(_backtraced, model=proto), "key string, chunk int, n_chunks int, ids array<int>")
    return repeated(traced.join(names, "key"), "times", "time").select("doc_id", "chunk", "n_chunks", "ids")


def _few(chunks: DataFrame, most: int = 200_000) -> bool:
    """Whether a row for each chunk (some 100 bytes) is small enough to go to every executor; the chunks then stay where they are."""
    return chunks.count() <= most


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, n_chunks, ids of docs (doc_id, text): a row for each row of docs, for giant texts one for each chunk.

    The ids of a text's chunks, in order, are those that the library gives for the whole text. A null text counts as empty and has no
    ids. Of repeated giant rows one is encoded and the result repeated. A text of any length is encoded whole; one that no path of
    pieces leads through raises. An empty table gives an empty result; other columns, whatever their names, aren't looked at.
    chunk: texts of more characters are giant.
    """
    proto, text = model_of(docs.sparkSession, model), texts(docs)
    small = text.filter(F.length("text") <= chunk).mapInArrow(partial(_encoded, model=proto, back=False), OUT)
    return small.unionByName(_giants(text, proto, chunk))


def model_of(spark, path: str = MODEL):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, chunk, n_chunks, text, n_tokens, ids_crc32 (of the ids as little-endian int32) for each row of encode's result.

    A document's text is its chunks' texts in order. U+2581 comes back as a space, as it does from the library. No ids give an empty
    text; an empty table gives an empty result.
    """
    columns = encoded.select("doc_id", "chunk", "n_chunks", "ids")
    return columns.mapInArrow(partial(_decoded, model=model_of(encoded.sparkSession, model), digest=False), "doc_id long, chunk int, n_chunks int, text string, n_tokens long, ids_crc32 long")


def encode_and_back(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """encode's columns with n_tokens, ids_crc32, and n_chars and text_sha256 of what decode gives for them.

    Texts that are encoded whole are decoded where they were encoded, so a worker holds one model and no ids travel twice.
    """
    proto, text = model_of(docs.sparkSession, model), texts(docs)
    small = text.filter(F.length("text") <= chunk).mapInArrow(partial(_encoded, model=proto, back=True), OUT + TOLD)
    return small.unionByName(_giants(text, proto, chunk).mapInArrow(partial(_decoded, model=proto, digest=True), OUT + TOLD))


def round_trip(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """encode_and_back without the ids."""
    return encode_and_back(docs, model, chunk).drop("ids")
