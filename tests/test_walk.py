"""Classification of a slab against a walk of one base at a time."""

import random

import numpy as np
import pyarrow as pa

from readqc_spark.operators import aln_stats, pileup


def one_read(pos, ops, seq, ref, begin):
    at = lambda p: ref[p - begin] if 0 <= p - begin < len(ref) else "?"
    out, p, q = [], pos, 0
    for op, n in ops:
        if op in "M=X":
            for _ in range(n):
                hit = op == "=" or (op == "M" and at(p) == seq[q])
                out.append(("match" if hit else "mismatch", False, 1, p, q, at(p) in "CG"))
                p, q = p + 1, q + 1
        elif op == "I" and n:
            new = set(seq[q : q + n])
            out.append(("ins", new == {at(p)} or new == {at(p + 1)}, n, p, -1, False))
            q += n
        elif op == "D":
            for _ in range(n):
                out.append(("del", at(p) in (at(p - 1), at(p + 1)), 1, p, -1, at(p) in "CG"))
                p += 1
        elif op == "S":
            q += n
        elif op == "N":
            p += n
    return out


def reads(count):
    rnd, rows = random.Random(7), []
    for i in range(count):
        ops = [(rnd.choice("MMM=XIDNSH"), rnd.randint(0, 12)) for _ in range(rnd.randint(0, 9))]
        bases = lambda n: "".join(rnd.choice("ACG") for _ in range(n))
        pos = rnd.randint(1, 30)
        begin = max(pos - 1, 1)
        span = sum(n for o, n in ops if o in "M=XDN")
        rows.append((pos, ops, bases(sum(n for o, n in ops if o in "M=XIS")), bases(pos - begin + span + rnd.randint(0, 2)), begin))
    return rows


def columns(rows):
    text = ["".join(f"{n}{o}" for o, n in ops) or random.Random(i).choice(["*", "", None]) for i, (_, ops, *_) in enumerate(rows)]
    return pa.array([r[0] for r in rows]), pa.array(text, pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows])


def test_walk_against_single_bases():
    rows = reads(400)
    w = pileup.walk(*columns(rows))
    got = [[] for _ in rows]
    for r, k, hp, n, p, q, gc in zip(w.row, w.kind, w.hp, w.n, w.ref_pos, w.qual_at, w.gc, strict=True):
        got[r].append((pileup.KINDS[k], bool(hp), int(n), int(p), int(q), bool(gc)))
    assert got == [one_read(*r) for r in rows]
    assert [int(x) for x in w.gaps[0]] == [sum(o == "I" for o, _ in r[1]) for r in rows]


def test_slabs_change_nothing(monkeypatch):
    cols = columns(reads(120))
    quals = pa.array([[j % 40 for j in range(len(s))] for s in cols[2].to_pylist()], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(120)), *cols, quals], ["aln_id", "pos", "cigar", "seq", "ref", "slice_start", "quals"])
    told = lambda: [r for b in aln_stats._counted([whole]) for r in b.to_pylist()]
    whole = batch
    for m in aln_stats.META:
        if m not in batch.schema.names:
            whole = whole.append_column(m, pa.nulls(120, pa.int32()))
    counts, events = told(), [r for b in pileup._classified([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(pileup, "SLAB", 50)
    assert told() == counts and len(counts) == 120 and [r for b in pileup._classified([batch]) for r in b.to_pylist()] == events
    assert list(aln_stats._counted([whole.slice(0, 0)])) == []
