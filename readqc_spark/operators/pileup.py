"""Each aligned base, insertion and deleted base of a read, classified.

A read carries only the slice of its contig from one base before to two after its span, so neighbours are at hand and nothing
larger than a read moves after the join. Reads are classified in Arrow batches: numpy works on all bases of a slab of reads at
once, so a base costs no row, struct or function call. A slab holds about SLAB bases, or one longer read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readqc_spark.operators import cigar

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800
#: Contigs of so many bases together are broadcast; of larger assemblies, tiles of TILE bases and OVERLAP more are joined by place.
BROADCAST_BASES, TILE, OVERLAP = 64 << 20, 1 << 18, 1 << 16
SLAB = 1 << 20
KINDS = ("match", "mismatch", "ins", "del")
MATCH, MISMATCH, INS, DEL = range(4)
TALLIES = ("matches", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del", "gc_bases", "gap_ins", "gap_del")


def flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def _counted() -> Column:
    return F.col("flags").bitwiseAND(UNMAPPED | SECONDARY) == 0


def mapped_primary(alignments: DataFrame) -> DataFrame:
    """Without unmapped and secondary records; supplementary ones stay."""
    return alignments.filter(_counted())


def primary(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.col("supplementary"))


def placed(alignments: DataFrame) -> DataFrame:
    """alignments with ops, aln_end and slice_start: what their own columns say of their place, without a contig."""
    return alignments.withColumn("ops", cigar.ops(F.col("cigar"))).withColumn("aln_end", F.col("pos") + cigar.span(F.col("ops"))).withColumn("slice_start", F.greatest(F.col("pos") - 1, F.lit(1)))


def with_contig(alignments: DataFrame, contigs: DataFrame, total_bases: int | None = None, longest: int | None = None) -> DataFrame:
    """alignments with ops, aln_end, contig_length, slice_start and ref (the slice's bases). A contig that isn't there raises.

    total_bases: of all contigs; where it is unknown or above BROADCAST_BASES, they are joined. longest: of the longest contig; where it is
    known and no more than TILE, contigs are joined whole, so that no read needs a second piece and the alignments are scanned once; else
    tiles are joined. Both bound memory alone: results don't depend on them.
    """
    rows = placed(alignments)
    small = total_bases is not None and total_bases <= BROADCAST_BASES
    if not small and (longest is None or longest > TILE):
        return _with_tiles(rows, contigs)
    c = contigs.select(F.col("chr").alias("_chr"), F.upper("seq").alias("_seq"))
    joined = rows.join(F.broadcast(c) if small else c, F.col("chr") == F.col("_chr"), "left")
    piece = F.substring(_there(F.col("_seq")), F.col("slice_start"), F.col("aln_end") - F.col("slice_start") + 3)
    return joined.withColumns({"ref": piece, "contig_length": F.length("_seq")}).drop("_chr", "_seq")


def _there(found: Column) -> Column:
    return F.when(found.isNull() & _counted(), F.raise_error(F.concat(F.lit("no such contig (or no such place in it) in the FASTA file: "), F.coalesce("chr", F.lit("null"))))).otherwise(found)


def _with_tiles(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """with_contig by an equality join on the contig and the tile in which a read's slice begins.

    No contig is moved or held whole but where it is cut up. A tile goes OVERLAP bases into the next, so most reads need one; one that
    goes further (long, or with a wide gap) gathers its pieces of all tiles by its aln_id. For these the alignments are scanned again.
    """
    cut = contigs.select(F.col("chr").alias("_chr"), "seq", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / TILE).cast("int"))).alias("_tile"))
    tiles = cut.select("_chr", "_tile", F.upper(F.substring("seq", F.col("_tile") * TILE + 1, F.lit(TILE + OVERLAP))).alias("_seq"), F.length("seq").alias("contig_length"))
    last = F.floor((F.col("aln_end") + 1) / TILE).cast("int")
    rows = rows.withColumn("_first", F.floor((F.col("slice_start") - 1) / TILE).cast("int"))
    one = F.coalesce(F.col("aln_end") + 2 <= (F.col("_first") + 1) * TILE + OVERLAP, F.lit(True))
    near = rows.filter(one).join(tiles, (F.col("chr") == F.col("_chr")) & (F.col("_first") == F.col("_tile")), "left")
    near = near.withColumn("ref", F.substring("_seq", F.col("slice_start") - F.col("_first") * TILE, F.col("aln_end") - F.col("slice_start") + 3))
    far = rows.filter(~one)
    parts = far.select("aln_id", "chr", "slice_start", "aln_end", F.explode(F.sequence("_first", last)).alias("_at")).join(tiles, (F.col("chr") == F.col("_chr")) & (F.col("_at") == F.col("_tile")))
    low, high = F.greatest(F.col("slice_start"), F.col("_at") * TILE + 1), F.least(F.col("aln_end") + 2, (F.col("_at") + 1) * TILE)
    parts = parts.select("aln_id", "_at", F.substring("_seq", low - F.col("_at") * TILE, high - low + 1).alias("_piece"), "contig_length")
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda x: x["_piece"]), "")
    far = far.join(parts.groupBy("aln_id").agg(F.max("contig_length").alias("contig_length"), gathered.alias("ref")), "aln_id", "left")
    out = near.drop("_chr", "_tile", "_seq", "_first").unionByName(far.drop("_first"))
    return out.withColumns({"contig_length": _there(F.col("contig_length")), "ref": _there(F.col("ref"))})


class Walk(NamedTuple):
    """Events in the order of the reads: the read's index, kind, whether a homopolymer's, bases, place, place in the slab's quals (-1: none), GC."""

    row: np.ndarray
    kind: np.ndarray
    hp: np.ndarray
    n: np.ndarray
    ref_pos: np.ndarray
    qual_at: np.ndarray
    gc: np.ndarray
    gaps: tuple[np.ndarray, np.ndarray]


_ON_REFERENCE, _ON_READ = cigar.MOVES
_COUNTED, _GC = cigar.marks(cigar.COUNTED), cigar.marks("CG")
_bytes = cigar.text_of


def _longs(numbers: pa.Array) -> np.ndarray:
    return numbers.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _letter(data: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, missing: int) -> np.ndarray:
    """data[first + at], missing where that lies outside of first to end."""
    place = first + at
    good = (at >= 0) & (place < end)
    if not len(data):
        return np.full(len(place), missing, np.uint8)
    return np.where(good, data[np.where(good, place, 0)], np.uint8(missing))


def walk(pos: pa.Array, cigars: pa.Array, seq: pa.Array, ref: pa.Array, slice_start: pa.Array) -> Walk:
    """The events of a slab of reads. seq and ref are in upper case; ref begins at slice_start.

    `=` is a match and `X` a mismatch whatever the bases. An insertion is one event; it is a homopolymer's if all its bases equal the
    reference base at its place, or all equal the one after that. A deleted base is one if it equals either neighbour.
    A missing base equals nothing.
    """
    rows = len(pos)
    (reads, read_at), (refs, ref_at) = _bytes(seq), _bytes(ref)
    row, op, length = cigar.operations(*_bytes(cigars))
    gaps = tuple(np.bincount(row[op == ord(x)], minlength=rows) for x in "ID")
    starts = [cigar.begins(row, length * moves[op], rows) for moves in (_ON_REFERENCE, _ON_READ)]
    place, query = starts[0] + _longs(pos)[row], starts[1]

    kept = _COUNTED[op] & (length > 0)
    row, op, length, place, query = row[kept], op[kept], length[kept], place[kept], query[kept]
    units = np.where(op == ord("I"), 1, length)
    of = np.repeat(np.arange(len(op)), units)
    j = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    r, o, p, q = row[of], op[of], place[of] + j, query[of] + j
    shift = _longs(slice_start)
    on_ref = lambda rr, pp: _letter(refs, ref_at[:-1][rr], ref_at[1:][rr], pp - shift[rr], 0)
    on_read = lambda rr, qq: _letter(reads, read_at[:-1][rr], read_at[1:][rr], qq, 1)

    here = on_ref(r, p)
    ins, dels = o == ord("I"), o == ord("D")
    hit = (o == ord("=")) | ((o == ord("M")) & (here == on_read(r, q)))
    kind = np.where(ins, INS, np.where(dels, DEL, np.where(hit, MATCH, MISMATCH))).astype(np.int8)
    hp = np.zeros(len(of), bool)
    d = np.flatnonzero(dels)
    hp[d] = (here[d] != 0) & ((here[d] == on_ref(r[d], p[d] - 1)) | (here[d] == on_ref(r[d], p[d] + 1)))
    i = np.flatnonzero(ins)
    if len(i):
        size = length[of[i]]
        begin = np.cumsum(size) - size
        each = np.repeat(i, size)
        new = on_read(r[each], q[each] + np.arange(len(each)) - np.repeat(begin, size))
        hp[i] = np.logical_and.reduceat(new == here[each], begin) | np.logical_and.reduceat(new == on_ref(r[each], p[each] + 1), begin)
    return Walk(r, kind, hp, np.where(ins, length[of], 1), p, np.where(ins | dels, -1, q), _GC[here] & ~ins, gaps)


def _slabs(seq: pa.Array, ref: pa.Array) -> Iterator[slice]:
    """Slices of reads of about SLAB bases together, or of one longer read."""
    size = np.diff(_bytes(seq)[1]) + np.diff(_bytes(ref)[1])
    i, total = 0, np.concatenate([[0], np.cumsum(size)])
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLAB, "right")) - 1)
        yield slice(i, j)
        i = j


def _present() -> Column:
    nothing = (F.coalesce(F.length("seq"), F.lit(0)) == 0) | (F.col("seq") == "*") | (F.coalesce(F.size("quals"), F.lit(0)) <= 0)
    return F.when(nothing & _counted(), F.raise_error(F.lit("a mapped read without bases or without qualities"))).otherwise(F.upper("seq"))


def _counts(w: Walk, rows: int) -> np.ndarray:
    """The TALLIES of a slab's reads, a line for each."""
    wanted = (w.kind == MATCH, w.kind == MISMATCH, (w.kind == INS) & ~w.hp, (w.kind == DEL) & ~w.hp, (w.kind == INS) & w.hp, (w.kind == DEL) & w.hp, w.gc)
    return np.stack([np.bincount(w.row[x], w.n[x], rows) for x in wanted] + list(w.gaps)).astype(np.int64)


def _quals(w: Walk, quals: pa.Array) -> pa.Array:
    """The quality of each event; null for gaps and where the read has none."""
    q = quals.fill_null([]) if quals.null_count else quals
    ends = np.concatenate([[0], np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False))])
    at = ends[w.row] + w.qual_at
    return q.flatten().cast(pa.int32()).take(pa.array(at, mask=(w.qual_at < 0) | (at >= ends[w.row + 1])))


def slabs(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, pa.Array], Walk]]:
    """The columns of each slab of a batch of walked() rows, and its events."""
    for some in _slabs(batch["seq"], batch["ref"]):
        c = {n: batch[n][some] for n in batch.schema.names}
        yield c, walk(c["pos"], c["cigar"], c["seq"], c["ref"], c["slice_start"])


def _only(w: Walk, wanted: np.ndarray) -> Walk:
    """The events of wanted kinds."""
    kept = wanted[w.kind]
    return Walk(*[x[kept] for x in w[:-1]], w.gaps)


def _classified(batches: Iterator[pa.RecordBatch], wanted: np.ndarray = np.ones(len(KINDS), bool)) -> Iterator[pa.RecordBatch]:
    names, strings = ["aln_id", "kind", "hp", "n", "ref_pos", "qual", "gc"], pa.array(KINDS)
    for b in batches:
        for c, w in slabs(b):
            w = w if wanted.all() else _only(w, wanted)
            kind = pa.DictionaryArray.from_arrays(pa.array(w.kind), strings).cast(pa.string())
            yield pa.RecordBatch.from_arrays([c["aln_id"].take(pa.array(w.row)), kind, pa.array(w.hp), pa.array(w.n.astype(np.int32)), pa.array(w.ref_pos.astype(np.int32)), _quals(w, c["quals"]), pa.array(w.gc.astype(np.int32))], names)


def walked(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of rows of with_contig that a walk needs, checked, and those named in more."""
    return rows.select("aln_id", "pos", "cigar", _present().alias("seq"), "ref", "slice_start", "quals", *more)


def events(rows: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One row for each event of kinds of rows of with_contig: aln_id, kind, hp, n (bases), ref_pos, qual (null for gaps), gc (of the reference's base)."""
    shape = T.StructType([rows.schema["aln_id"], *T._parse_datatype_string("kind string, hp boolean, n int, ref_pos int, qual int, gc int").fields])
    return walked(rows).mapInArrow(partial(_classified, wanted=np.isin(KINDS, kinds)), shape)
