"""Intervals on the reference, 1-based and half-open: generators by alignment, BED overlap, and what lies in an interval.

All intervals of a read belong to it alone, so they are made, and the read's events are found in them, where the read is walked: in
slabs of reads with numpy. A generator is a function of a Slab that gives (read, start, stop, label's number) arrays and the labels.
An interval's events are a range of the slab's, found by binary search; counts are differences of running sums. Neither bases nor
intervals are shuffled; integer sums by feature are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc_spark.operators import pileup

#: Width of the bins that turn the overlap of two tables into an equality join.
OVERLAP_BIN = 4096
#: A BED table of so many rows is broadcast; a larger one is joined, and each read carries its rows.
BROADCAST_BED = 1_000_000
#: So many events in intervals are held at once.
AT_ONCE = 1 << 20
_OTHER = np.zeros(256, np.uint8)
_OTHER[list(b"ACGTN")] = list(b"TGCAN")
COUNTS = pileup.TALLIES[:6]


class Found(NamedTuple):
    """Intervals of a slab: the read's index, its bounds, and its label's number."""

    read: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    label: np.ndarray
    labels: list[str]


class Slab:
    """Alignments' bounds and strands, and the reference's bases along them."""

    def __init__(self, columns: dict[str, pa.Array]):
        whole = lambda name: columns[name].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        self.columns, self.pos, self.end = columns, whole("pos"), whole("aln_end")
        self.reverse = whole("flags") & pileup.REVERSE != 0
        self.span = np.maximum(self.end - self.pos, 0)
        self._bases: tuple | None = None

    def bases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(aligned bases of all reads, the read of each, where each read's begin, how many it has)."""
        if self._bases is None:
            data, at = pileup._bytes(self.columns["ref"])
            skip = self.pos - pileup._longs(self.columns["slice_start"])
            n = np.clip(np.minimum(self.span, np.diff(at) - skip), 0, None)
            read, j = spread(n)
            self._bases = (data[(at[:-1] + skip)[read] + j] if len(read) else np.zeros(0, np.uint8), read, np.cumsum(n) - n, n)
        return self._bases


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 to len(n) - 1, each as often as n says, and the number of each within its own."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _homopolymers(s: Slab) -> Found:
    b, read, first, _ = s.bases()
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (read[1:] != read[:-1])])[: len(b)]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(b)))
    at, n = at[n > 1], n[n > 1]
    r = read[at]
    keys, label = np.unique(n * 256 + np.where(s.reverse[r], _OTHER[b[at]], b[at]), return_inverse=True)
    start = s.pos[r] + at - first[r]
    return Found(r, start, start + n, label, [f"{k >> 8:>5}{chr(k & 255)}" for k in keys.tolist()])


def homopolymers() -> Callable[[Slab], Found]:
    """Runs of two or more equal bases, clipped to the alignment; the label is the length, five wide, and the base on the read's strand."""
    return _homopolymers


def _windows(s: Slab, width: int, positions: bool) -> Found:
    n = -(-s.span // width)
    r, j = spread(n)
    o, low, high = j * width, s.pos[r], s.end[r]
    start = np.where(s.reverse[r], np.maximum(high - o - width, low), low + o)
    stop = np.where(s.reverse[r], high - o, np.minimum(low + o + width, high))
    if positions:
        return Found(r, start, stop, j, [f"window_{width}_pos_{k * width}" for k in range(int(n.max(initial=0)))])
    return Found(r, start, stop, np.zeros(len(r), np.int64), [f"window_{width}"])


def windows(width: int, positions: bool = False) -> Callable[[Slab], Found]:
    """Consecutive windows from the read's 5' end, the last one short; with positions, labelled by their offset too."""
    return partial(_windows, width=width, positions=positions)


def _borders(s: Slab, width: int) -> Found:
    r, j = spread(np.maximum(s.span - 1, 0) // width)
    o, low, high = (j + 1) * width, s.pos[r], s.end[r]
    at = np.where(s.reverse[r], high - o, low + o)
    return Found(r, np.maximum(at - 2, low), np.minimum(at + 2, high), np.zeros(len(r), np.int64), [f"border_{width}"])


def borders(width: int) -> Callable[[Slab], Found]:
    """Two bases on either side of each border between windows."""
    return partial(_borders, width=width)


def _matches(s: Slab, pattern: bytes) -> Found:
    b, read, first, n = s.bases()
    other = bytes(_OTHER[list(pattern)][::-1])
    size = max(len(b) - len(pattern) + 1, 0)
    back, hit = s.reverse[read[:size]], np.ones(size, bool)
    for k, (x, y) in enumerate(zip(pattern, other, strict=True)):
        hit &= b[k : k + size] == np.where(back, y, x)
    at = np.flatnonzero(hit)
    r = read[at]
    inside = at - first[r] + len(pattern) <= n[r]
    at, r = at[inside], r[inside]
    start = s.pos[r] + at - first[r]
    return Found(r, start, start + len(pattern), np.zeros(len(r), np.int64), [pattern.decode()])


def matches(pattern: str) -> Callable[[Slab], Found]:
    """Every place where the reference has pattern on the read's strand, overlapping ones too."""
    return partial(_matches, pattern=pattern.upper().encode())


def _indexed(s: Slab, index) -> Found:
    """BED rows of a broadcast index that overlap each alignment, whole."""
    tables, labels = index.value
    out = []
    names = s.columns["chr"].dictionary_encode()
    which = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for k, name in enumerate(names.dictionary.to_pylist()):
        if name not in tables:
            continue
        start, stop, reach, label = tables[name]
        mine = np.flatnonzero(which == k)
        low, high = np.searchsorted(reach, s.pos[mine], "right"), np.searchsorted(start, s.end[mine], "left")
        of, j = spread(np.maximum(high - low, 0))
        at = low[of] + j
        good = stop[at] > s.pos[mine][of]
        out.append((mine[of][good], start[at][good], stop[at][good], label[at][good]))
    parts = [np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(4)]
    return Found(*parts, labels)


def _listed(s: Slab, column: str) -> Found:
    """BED rows that each read carries in a column."""
    lists = s.columns[column]
    lists = lists.fill_null([]) if lists.null_count else lists
    rows, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    label = rows.field("feature_key").dictionary_encode()
    start, stop = (rows.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "stop"))
    return Found(spread(n)[0], start, stop, label.indices.to_numpy(zero_copy_only=False), label.dictionary.to_pylist())


def with_beds(rows: DataFrame, beds: Sequence[DataFrame], placed: DataFrame | None = None) -> tuple[DataFrame, list[Callable[[Slab], Found]]]:
    """(rows, generators) of BED tables (chr, start, stop, feature). A table of up to BROADCAST_BED rows goes to all tasks as an index.

    placed: pileup.placed() of the same alignments, by which a larger table is joined, so that rows aren't joined with the contigs for it too.
    Tables are counted first: a limit would bring all rows to one task.
    """
    kinds: list = []
    for k, bed in enumerate(beds):
        bed = bed.select("chr", "start", "stop", "feature")
        if bed.count() > BROADCAST_BED:
            mine = bed_overlap(rows if placed is None else placed, bed).groupBy("aln_id").agg(F.collect_list(F.struct("start", "stop", "feature_key")).alias(f"_bed{k}"))
            rows = rows.join(mine, "aln_id", "left")
            kinds.append(partial(_listed, column=f"_bed{k}"))
            continue
        some = bed.toArrow().sort_by([("chr", "ascending"), ("start", "ascending")]).combine_chunks()
        chr_, label = some["chr"].combine_chunks().dictionary_encode(), some["feature"].combine_chunks().dictionary_encode()
        start, stop = (some[x].to_numpy().astype(np.int64) for x in ("start", "stop"))
        number, tables = label.indices.to_numpy(zero_copy_only=False), {}
        ends = np.searchsorted(chr_.indices.to_numpy(zero_copy_only=False), np.arange(len(chr_.dictionary) + 1))
        for i, name in enumerate(chr_.dictionary.to_pylist()):
            a, b = int(ends[i]), int(ends[i + 1])
            tables[name] = (start[a:b], stop[a:b], np.maximum.accumulate(stop[a:b]), number[a:b])
        kinds.append(partial(_indexed, index=rows.sparkSession.sparkContext.broadcast((tables, label.dictionary.to_pylist()))))
    return rows, kinds


def _columns(rows: DataFrame) -> list[str]:
    return ["aln_end", "flags", "chr", *[c for c in rows.columns if c.startswith("_bed")]]


def _generated(batches: Iterator[pa.RecordBatch], kinds) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for some in pileup._slabs(b["ref"], b["ref"]):
            slab = Slab({n: b[n][some] for n in b.schema.names})
            for kind in kinds:
                f = kind(slab)
                key = pa.array(f.labels, pa.string()).take(pa.array(f.label))
                yield pa.RecordBatch.from_arrays([slab.columns["aln_id"].take(pa.array(f.read)), pa.array(f.start.astype(np.int32)), pa.array(f.stop.astype(np.int32)), key], ["aln_id", "start", "stop", "feature_key"])


def generated(rows: DataFrame, kinds: Sequence[Callable[[Slab], Found]]) -> DataFrame:
    """aln_id, start, stop, feature_key of all generators together, duplicates kept. rows: with_contig's."""
    shape = f"aln_id {rows.schema['aln_id'].dataType.simpleString()}, start int, stop int, feature_key string"
    return rows.select("aln_id", "pos", "ref", "slice_start", *_columns(rows)).mapInArrow(partial(_generated, kinds=list(kinds)), shape)


def bed_overlap(rows: DataFrame, bed: DataFrame, width: int = OVERLAP_BIN) -> DataFrame:
    """aln_id, start, stop, feature_key of the BED rows that overlap each alignment, whole; a pair is kept in its first common bin."""
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width))
    a = rows.select("aln_id", "chr", F.col("pos").alias("s"), F.col("aln_end").alias("e"), F.explode(bins(F.col("pos"), F.col("aln_end"))).alias("bin"))
    b = bed.select(F.col("chr").alias("bchr"), "start", "stop", F.col("feature").alias("feature_key"), F.explode(bins(F.col("start"), F.col("stop"))).alias("bbin"))
    first = F.greatest(F.floor(F.col("s") / width), F.floor(F.col("start") / width))
    on = (F.col("chr") == F.col("bchr")) & (F.col("bin") == F.col("bbin")) & (F.col("start") < F.col("e")) & (F.col("stop") > F.col("s")) & (F.col("bin") == first)
    return a.join(b, on).select("aln_id", "start", "stop", "feature_key")


class Events:
    """A slab's events in their order, and which of them lie in intervals."""

    def __init__(self, slab: Slab, w: pileup.Walk):
        self.slab, self.w = slab, w
        self.wide = int(slab.span.max(initial=0)) + 3
        self.key = w.row * self.wide + (w.ref_pos - slab.pos[w.row])

    def within(self, f: Found) -> tuple[np.ndarray, np.ndarray]:
        """First and end of each interval's events."""
        low, high = (f.read * self.wide + np.clip(x - self.slab.pos[f.read], 0, self.wide - 1) for x in (f.start, f.stop))
        a, b = np.searchsorted(self.key, low), np.searchsorted(self.key, high)
        return a, np.maximum(a, b)

    def runs(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of all events before each."""
        return np.concatenate([[0], np.cumsum(values)])


def _summed(label: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(label, values, n).astype(np.int64)


def _stabbed(batches: Iterator[pa.RecordBatch], kinds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for columns, w in pileup.slabs(batch):
            e = Events(Slab(columns), w)
            totals = [(k, e.runs(w.kind == k), e.runs(np.where(w.kind == k, w.ref_pos, 0))) for k in range(len(pileup.KINDS))]
            for kind in kinds:
                f = kind(e.slab)
                a, b = e.within(f)
                for k, hits, places in totals:
                    n = [pa.array(_summed(f.label, x[b] - x[a], len(f.labels))) for x in (hits, places)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.labels, pa.string()), pa.array([pileup.KINDS[k]] * len(f.labels), pa.string()), *n], ["feature_key", "kind", "hits", "places"])


def stabbed(rows: DataFrame, kinds: Sequence[Callable[[Slab], Found]]) -> DataFrame:
    """feature_key, kind, hits, places (their sum): the events in intervals, one for each interval that holds an event's place."""
    made = pileup.walked(rows, *_columns(rows)).mapInArrow(partial(_stabbed, kinds=list(kinds)), "feature_key string, kind string, hits long, places long")
    return made.groupBy("feature_key", "kind").agg(F.sum("hits").alias("hits"), F.sum("places").alias("places")).filter("hits > 0")


PARTIAL = "feature_key string, hist boolean, qual int, intervals long, identical long, " + ", ".join(f"{c} long" for c in COUNTS)
_ALL = Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ["all_alignments"])


def _histogram(label: np.ndarray, qual: np.ndarray, hit: np.ndarray, into: dict) -> None:
    """Counts of (label, quality, match or mismatch), added up in into; -1 for no quality."""
    keys, counts = np.unique((label * 512 + qual + 1) * 2 + hit, return_counts=True)
    for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
        into[k] = into.get(k, 0) + n


def _rows_of(labels: list[str], counts: dict) -> pa.RecordBatch:
    by: dict = {}
    for k, n in counts.items():
        by.setdefault(k >> 1, [0, 0])[1 - (k & 1)] += n
    keys = sorted(by)
    nothing = pa.array(np.zeros(len(keys), np.int64))
    qual = pa.array([None if k % 512 == 0 else k % 512 - 1 for k in keys], pa.int32())
    columns = [pa.array([labels[k // 512] for k in keys], pa.string()), pa.array([True] * len(keys), pa.bool_()), qual, nothing, nothing, *[pa.array([by[k][i] for k in keys], pa.int64()) for i in (0, 1)], *[nothing] * 4]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARTIAL.split(", ")])


def partial_sums(slab: Slab, w: pileup.Walk, quals: pa.Array, kinds, everything: bool = True) -> Iterator[pa.RecordBatch]:
    """PARTIAL rows of a slab: by feature, counts; by feature and quality, matches and mismatches (hist). everything: of all aligned bases too."""
    e = Events(slab, w)
    qual = pileup._quals(w, quals).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    aligned = w.kind <= pileup.MISMATCH
    if everything:
        counts: dict = {}
        _histogram(np.zeros(int(aligned.sum()), np.int64), qual[aligned], w.kind[aligned] == pileup.MATCH, counts)
        yield _rows_of(_ALL.labels, counts)
    if not kinds:
        return
    wanted = (w.kind == pileup.MATCH, w.kind == pileup.MISMATCH, (w.kind == pileup.INS) & ~w.hp, (w.kind == pileup.DEL) & ~w.hp, (w.kind == pileup.INS) & w.hp, (w.kind == pileup.DEL) & w.hp)
    totals, wrong = [e.runs(np.where(x, w.n, 0)) for x in wanted], e.runs(w.kind != pileup.MATCH)
    for kind in kinds:
        f = kind(slab)
        a, b = e.within(f)
        n = len(f.labels)
        numbers = [np.bincount(f.label, minlength=n), np.bincount(f.label[wrong[a] == wrong[b]], minlength=n), *[_summed(f.label, x[b] - x[a], n) for x in totals]]
        used = np.flatnonzero(numbers[0])
        columns = [pa.array([f.labels[i] for i in used], pa.string()), pa.array([False] * len(used), pa.bool_()), pa.nulls(len(used), pa.int32()), *[pa.array(x[used].astype(np.int64)) for x in numbers]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARTIAL.split(", ")])
        counts, ends, i = {}, np.cumsum(b - a), 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
            of, k = spread(b[i:j] - a[i:j])
            at = a[i:j][of] + k
            good = aligned[at]
            at, of = at[good], of[good]
            _histogram(f.label[i:j][of], qual[at], w.kind[at] == pileup.MATCH, counts)
            i = j
        yield _rows_of(f.labels, counts)


def _attributed(batches: Iterator[pa.RecordBatch], kinds, everything: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for columns, w in pileup.slabs(batch):
            yield from partial_sums(Slab(columns), w, columns["quals"], kinds, everything)


def attributed(rows: DataFrame, kinds: Sequence[Callable[[Slab], Found]], everything: bool = True) -> DataFrame:
    """PARTIAL rows of rows of with_contig: integers, to be summed by feature_key, hist and qual. No shuffle."""
    return pileup.walked(rows, *_columns(rows)).mapInArrow(partial(_attributed, kinds=list(kinds), everything=everything), PARTIAL)
