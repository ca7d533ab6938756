"""CIGAR strings as arrays, with each operation's place on the reference and the read. All of it is row-local and linear."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ON_REFERENCE, ON_READ, COUNTED = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S"), ("=", "X", "M", "I", "D")
COORDS = pa.struct([("op", pa.string()), ("len", pa.int32()), ("ref_start", pa.int32()), ("query_start", pa.int32())])


def ops(cigar: Column) -> Column:
    """array<struct<op, len>>; empty for null and *; an unknown or padding operation raises."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSH=X])"), F.lit(0))
    # What is left once all operations are taken out; a pattern for the whole string would recurse for each operation.
    good = cigar.isNull() | (cigar == "*") | (F.regexp_replace(cigar, "[0-9]+[MIDNSH=X]", "") == "")
    parsed = F.transform(parts, lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("len")))
    shown = F.concat(F.lit("CIGAR with an operation that isn't counted here: "), F.substring(cigar, 1, 200))
    return F.when(good, F.coalesce(parsed, F.expr("cast(array() as array<struct<op:string,len:int>>)"))).otherwise(F.raise_error(shown))


def _length(o: Column, kinds: tuple[str, ...]) -> Column:
    return F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)


def span(parsed: Column) -> Column:
    return F.aggregate(parsed, F.lit(0), lambda a, o: a + _length(o, ON_REFERENCE))


def query_length(parsed: Column) -> Column:
    return F.aggregate(parsed, F.lit(0), lambda a, o: a + _length(o, ON_READ))


def text_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each string begins and the last ends); null as empty."""
    a = strings.fill_null("").cast(pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def marks(letters: tuple[str, ...] | str) -> np.ndarray:
    """For each byte, whether it is one of letters."""
    out = np.zeros(256, bool)
    out[[ord(x) for x in letters]] = True
    return out


MOVES = marks(ON_REFERENCE), marks(ON_READ)


def operations(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, letter, length) of each operation of CIGAR strings; * has none."""
    base, text = at[0], text[at[0] : at[-1]]
    letters = np.flatnonzero((text > ord("9")) | (text == ord("*")))
    digits = np.flatnonzero((text >= ord("0")) & (text <= ord("9")))
    of = np.searchsorted(letters, digits)
    weight = 10.0 ** (letters[of] - digits - 1) if len(of) else np.zeros(0)
    length = np.bincount(of, (text[digits] - ord("0")) * weight, minlength=len(letters)).astype(np.int64)
    row, op = np.searchsorted(at[1:] - base, letters, "right"), text[letters]
    real = op != ord("*")
    return row[real], op[real], length[real]


def begins(row: np.ndarray, step: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the steps before each operation, from its read's first one on."""
    before = np.cumsum(step) - step
    first = np.searchsorted(row, np.arange(rows))
    return before - before[first[row]] if len(row) else before


def _coords(cigars: pa.Array, pos: pa.Array) -> pa.Array:
    row, op, length = operations(*text_of(cigars))
    on_ref, on_read = (begins(row, length * m[op], len(cigars)) for m in MOVES)
    start = pos.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[row] + on_ref
    letters = pa.array([bytes([k]).decode() for k in range(128)]).take(pa.array(op.astype(np.int64)))
    each = pa.StructArray.from_arrays([letters, *[pa.array(x.astype(np.int32)) for x in (length, start, on_read + 1)]], fields=list(COORDS))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(cigars) + 1)).astype(np.int32)), each)


def coords(cigar: Column, pos: Column) -> Column:
    """array<struct<op, len, ref_start, query_start>>, 1-based, of a CIGAR string that ops() lets through."""
    return F.arrow_udf(_coords, "array<struct<op:string,len:int,ref_start:int,query_start:int>>")(cigar, pos)
