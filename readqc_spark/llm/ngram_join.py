"""Jaccard self-join of texts on word n-grams by rare-first prefix filtering.

1. Each text becomes a set of 64-bit shingle hashes, of which only its size and a 128-bit signature leave the task, and a count
   sketch of fixed size (SKETCH counters, whatever the corpus). Texts with equal sets become one node.
2. A node's shingles are put in one global order, rarest first by the sketch. Two sets that link must share a shingle within both
   prefixes, so prefixes alone are shuffled; shingles that one node has alone are dropped at once. A shingle that the sketch shows to
   be frequent is dealt over several tasks by its nodes.
3. A prefix shingle of up to FEW nodes pairs them all; one of more nodes pairs each with the node that has it earliest. Candidates
   pass the length, positional and suffix filters and are verified exactly, once per pair. What links is joined into components.
4. Where such a larger shingle's nodes are still in several components, its pairs across components are formed between classes of
   neighbouring lengths, in blocks, filtered and verified. Pairs inside a component can't change the result and aren't formed, so a
   large group of near copies costs as many candidates as it has members, and no link between components is missed.
5. For the number of links, every pair within a component is verified: a component's nodes are dealt into parts, and each two parts
   meet in one place, so a node's text is sent once per part, not once per pair.

The suffix filter is the one-level form: shingles are dealt into BINS parts by hash, and the sum of differences of the parts' sizes
bounds the sets' symmetric difference from below.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readqc_spark.llm.common import cut, mix64, parts_of, texts, word_hashes
from readqc_spark.llm.url_filter import BLOCKS, LANES, _lanes, bloom

SKETCH, SLICE, SALTS, BINS = 1 << 22, 1 << 16, 64, 32
#: A shingle of more texts than this, and than sixteen times what a counter holds on average, is dealt over several tasks.
HOT = 1024
#: Nodes of a shared shingle are compared in blocks of about so many.
BLOCK = 512
#: Prefix shingles of at most so many nodes form all their pairs at once.
FEW = 16
#: So many candidates of one node at most are verified in one place.
LEAVES = 256
#: A part of a component has about so many nodes and so many shingles at most; SLAB shingles are compared at once.
PART, PART_SHINGLES, SLAB = 128, 1 << 20, 8192
#: Up to so many edges are joined into components in one task (two MB for each 2^17), more of them in rounds over the cluster.
AT_ONCE = 1 << 18
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(strings: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each string; a text of fewer words is one shingle, one without words none."""
    for some in parts_of(strings):
        each, counts = word_hashes([b for _, b in some])
        with np.errstate(over="ignore"):
            full = np.zeros(max(0, len(each) - words + 1), np.uint64)
            for k in range(words):
                full = mix64(full + each[k : len(each) - words + 1 + k] + np.uint64(2 * k + 1))
        first = 0
        for (i, _), n in zip(some, counts.tolist(), strict=True):
            if n >= words:
                yield i, np.unique(full[first : first + n - words + 1])
            elif n:
                with np.errstate(over="ignore"):
                    one = np.full(1, n, np.uint64) << np.uint64(32)
                    for h in each[first : first + n]:
                        one = mix64(one + h)
                yield i, one
            else:
                yield i, np.empty(0, np.uint64)
            first += n


def signature(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix64(tokens ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (_A, _B))


SIGNED = "doc_id long, text_key long, n int, na long, nb long, bins array<short>, slice int, salt int, counts binary"


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    counts, names = np.zeros(SKETCH, np.uint32), [x.split()[0] for x in SIGNED.split(", ")]
    none = lambda n: [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int16()))]
    for b in batches:
        rows, bins = [], []
        for _, tokens in shingle_sets(b["text"], words):
            np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            bins.append(np.bincount((tokens >> np.uint64(59)).astype(np.int64), minlength=BINS).clip(0, 32767).astype(np.int16))
            rows.append((len(tokens), *signature(tokens)))
        if rows:
            n, na, nb = np.array(rows, np.int64).T
            dealt = pa.ListArray.from_arrays(pa.array(np.arange(0, BINS * len(rows) + 1, BINS, dtype=np.int32)), pa.array(np.concatenate(bins)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(n.astype(np.int32)), pa.array(na), pa.array(nb), dealt, *[pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.binary())]], names)
    salt = TaskContext.get().partitionId() % SALTS
    for i, part in enumerate(counts.reshape(-1, SLICE)):
        if part.any():
            yield pa.RecordBatch.from_arrays([*none(1), pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)


def _added(t: pa.Table) -> pa.Table:
    return _summed(t, lambda total: zlib.compress(total.tobytes(), 1))


def _ranked(t: pa.Table) -> pa.Table:
    """A slice's counters as ranks, four for each doubling, a byte each."""
    return _summed(t, lambda total: np.floor(4 * np.log2(1 + total.astype(np.float64))).astype(np.uint8).tobytes())


def _summed(t: pa.Table, form) -> pa.Table:
    total = np.zeros(SLICE, np.uint64)
    for b in t["counts"]:
        raw = zlib.decompress(b.as_py())
        total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * SLICE else np.uint64)
    return pa.table({"slice": t["slice"].slice(0, 1), "salt": t["salt"].slice(0, 1), "counts": pa.array([form(total)], pa.binary())})


def _sketch(first: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are, as ranks in bytes: SKETCH bytes, whatever the corpus."""
    kind = "slice int, salt int, counts binary"
    some = first.filter("slice is not null").select("slice", "salt", "counts").groupBy("slice", "salt").applyInArrow(_added, kind)
    total = np.zeros((SKETCH // SLICE, SLICE), np.uint8)
    for r in some.groupBy("slice").applyInArrow(_ranked, kind).collect():
        total[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return total.ravel()


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, sketch) -> Iterator[pa.RecordBatch]:
    rank, seen, names = sketch.value, set(), ["token", "na", "at", "salts"]
    often = np.exp2(np.arange(256) / 4)
    salts = 1 + (often / max(HOT, 16 * float(often[rank].mean() - 1))).astype(np.int64).clip(0, 1 << 20)
    for b in batches:
        tokens_, a_, at_, size = [], [], [], 0
        for _, tokens in shingle_sets(b["text"], words):
            n = len(tokens)
            if not n or (key := signature(tokens)) in seen:
                continue
            if len(seen) >= 50_000:  # copies are dropped here to save shuffle; those that slip through are dropped after it
                seen.clear()
            seen.add(key)
            p = n - -(-percent * n // 100) + 1
            order = np.argsort(rank[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[:p]
            tokens_.append(tokens[order].view(np.int64))
            a_.append(np.full(p, key[0]))
            at_.append((np.arange(p) << 32) + n)
            size += p
            if size > 200_000:
                yield _batch(names, tokens_, a_, at_, salts, rank)
                tokens_, a_, at_, size = [], [], [], 0
        if size:
            yield _batch(names, tokens_, a_, at_, salts, rank)


def _batch(names, tokens, a, at, salts: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    token = np.concatenate(tokens)
    dealt = salts[rank[(token.view(np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64)]]
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate(a)), pa.array(np.concatenate(at)), pa.array(dealt.astype(np.int32))], names)


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a hub and one of its leaves that link; the rows of a hub and salt follow each other, the hub first."""
    at, mine = None, np.empty(0, np.uint64)
    for b in batches:
        hubs, salts, leafy, ids, na, nb = (b[c].to_pylist() for c in ("hub", "salt", "leafy", "nid", "na", "nb"))
        rows = []
        for i, tokens in shingle_sets(b["text"], words):
            if signature(tokens) != (na[i], nb[i]):  # another text of the same doc_id
                continue
            if not leafy[i]:
                at, mine = (hubs[i], salts[i]), tokens
            elif at == (hubs[i], salts[i]):
                place = np.searchsorted(mine, tokens)
                shared = int((mine[np.minimum(place, len(mine) - 1)] == tokens).sum())
                if 100 * shared >= percent * (len(mine) + len(tokens) - shared):
                    rows.append((min(hubs[i], ids[i]), max(hubs[i], ids[i])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _needed(percent: int, n1: Column, n2: Column) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(float(100 + percent)) - F.lit(1e-9))


def _may_link(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and positional filters for a shared shingle at places p1 and p2, the first that the two share."""
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= _needed(percent, n1, n2))


def _verified(pairs: DataFrame, nodes: DataFrame, text: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the suffix filter first, then the whole sets of the texts that are left in some pair."""
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    near = cut(near.filter(apart <= F.col("n_a") + F.col("n_b") - 2 * _needed(percent, F.col("n_a"), F.col("n_b"))).select("a", "b"))
    # Of a pair, the node of more candidates is the hub. A leaf's text goes to its hub alone, a hub's text once for LEAVES leaves or so.
    degree = near.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("d"))
    dealt = near.join(degree.select(F.col("nid").alias("a"), F.col("d").alias("d_a")), "a").join(degree.select(F.col("nid").alias("b"), F.col("d").alias("d_b")), "b")
    dealt = dealt.select(F.when(F.col("d_a") >= F.col("d_b"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("d_a") >= F.col("d_b"), F.col("b")).otherwise(F.col("a")).alias("nid"), F.greatest("d_a", "d_b").alias("d"))
    dealt = dealt.select("hub", F.pmod(F.xxhash64("nid"), F.ceil(F.col("d") / LEAVES)).alias("salt"), F.lit(True).alias("leafy"), "nid")
    roles = dealt.unionByName(dealt.select("hub", "salt", F.lit(False).alias("leafy"), F.col("hub").alias("nid")).distinct())
    wanted = cut(roles.join(nodes.select("nid", "na", "nb", "rep", "rep_key"), "nid"))
    some = _texts_of(wanted, text).select("hub", "salt", "leafy", "nid", "na", "nb", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leafy")
    return some.mapInArrow(partial(_linked, words=words, percent=percent), "a long, b long").distinct()


def _texts_of(wanted: DataFrame, text: DataFrame) -> DataFrame:
    """wanted with the texts of its rep and rep_key; other texts of the same key and repeated rows may be among them."""
    # A filter of fixed size keeps most other texts out of the shuffle.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    listed = wanted.select(F.coalesce(F.col("rep").cast("string"), F.lit("null")).alias("url_key"))
    some = text.withColumns({"block": F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int"), **{f"bit{k}": x for k, x in enumerate(_lanes(key))}}).join(F.broadcast(bloom(listed)), "block")
    for k in range(LANES):
        some = some.filter(F.col(f"lane{k}").bitwiseAND(F.col(f"bit{k}")) == F.col(f"bit{k}"))
    return some.select("doc_id", "text_key", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key")))


def _met(t: pa.Table, words: int, percent: int, slab: int) -> pa.Table:
    """nid, n_links: rows that the nodes of two parts (or of one with itself) link to in the other."""
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    na, nb, ids, parts, weights = (t[c].to_pylist() for c in ("na", "nb", "nid", "part", "w"))
    sets: dict = {}
    for i, tokens in shingle_sets(t["text"].combine_chunks(), words):
        if signature(tokens) == (na[i], nb[i]):
            sets[ids[i]] = (parts[i], weights[i], tokens)
    nids, found = np.array(list(sets), np.int64), list(sets.values())
    part, w, n = (np.array(x, np.int64) for x in ([x[0] for x in found], [x[1] for x in found], [len(x[2]) for x in found]))
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    shared = np.zeros((len(left), len(right)), np.int64)
    if shared.size:
        _, column, held_by = np.unique(np.concatenate([x[2] for x in found]), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(n)), n), held_by[column] > 1
        row, column = row[often], (np.cumsum(held_by > 1) - 1)[column[often]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
            a, b = np.searchsorted(column, [c, c + slab])
            has = np.zeros((len(n), slab), np.float32)
            has[row[a:b], column[a:b] - c] = 1
            shared += (has[left] @ has[right].T).astype(np.int64)
    linked = 100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)
    if low == high:
        np.fill_diagonal(linked, False)
    out = [(nids[left], linked @ w[right])] + ([] if low == high else [(nids[right], linked.T @ w[left])])
    return pa.table({"nid": np.concatenate([x for x, _ in out]), "n_links": np.concatenate([x for _, x in out])})


def _n_links(nodes: DataFrame, roots: DataFrame, text: DataFrame, words: int, percent: int) -> DataFrame:
    """nid, n_links of the nodes that link with others: how many rows of docs those are. All links are within components."""
    member = nodes.join(roots, nodes["nid"] == roots["node"], "left").select("nid", "n", "na", "nb", "rep", "rep_key", "w", F.coalesce("root", "nid").alias("root"))
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long")).alias("all_n")).filter("m > 1")
    size = size.select("root", F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("all_n") / PART_SHINGLES)).alias("parts"))
    dealt = member.join(size, "root").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    wanted = cut(dealt.select("root", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"), "part", "nid", "na", "nb", "w", "rep", "rep_key"))
    met = _texts_of(wanted, text).select("root", "low", "high", "part", "nid", "na", "nb", "w", "text").groupBy("root", "low", "high")

    slab = SLAB

    def each(t: pa.Table) -> pa.Table:
        return _met(t, words, percent, slab)

    return met.applyInArrow(each, "nid long, n_links long").groupBy("nid").agg(F.sum("n_links").alias("n_links"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges (v, u) of the batches, but those of the roots themselves."""
    ends = [np.stack([b["v"].to_numpy(), b["u"].to_numpy()]) for b in batches if b.num_rows]
    ids, at = np.unique(np.concatenate(ends, 1) if ends else np.empty((2, 0), np.int64), return_inverse=True)
    v, u = at.reshape(2, -1)
    root = np.arange(len(ids))
    while len(v):  # ids are sorted, so the smallest place is the smallest node
        x, y = root[v], root[u]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (above := root[root] < root).any():
            root[above] = root[root[above]]
        apart = root[v] != root[u]
        v, u = v[apart], u[apart]
    some = root < np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node of edges (a, b) but the roots.

    Up to AT_ONCE edges are joined in one task. More take large and small stars in turn, until nothing changes: a dozen shuffles each.
    """
    now, last = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct()), None
    if now.count() <= AT_ONCE:
        return cut(now.coalesce(1).mapInArrow(_joined, "node long, root long"))
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy(F.col("v").alias("k")).agg(F.min("u").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(lowest, both["v"] == lowest["k"]).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        lowest = large.groupBy(F.col("v").alias("k")).agg(F.min("u").alias("m"))
        small = large.join(lowest, large["v"] == lowest["k"])
        now = cut(small.select("u", "m").unionByName(small.select(F.col("v").alias("u"), "m")).filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        last = state


def _across(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a token, are in different components and pass the length and positional filters.

    marked: token, nid, n, p, root. A token's nodes meet by classes of length, of which a link's ends are at most one apart, and in
    blocks: each node goes to one block, and meets there the other nodes of its class and the class below.
    """
    some = marked.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("r0 <> r1").select("token", "blocks")
    rest = cut(marked.join(some, "token").withColumn("class", F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-9)) if percent < 100 else F.col("n")))
    x = rest.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks"))).alias("x")
    y = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("near", F.explode(F.array(F.col("class"), F.col("class") + 1))).alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.class") == F.col("y.near")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("x.class") != F.col("y.class")) | (F.col("x.nid") < F.col("y.nid"))
    pairs = x.join(y, meet & once & _may_link(percent, F.col("x.n"), F.col("x.p"), F.col("y.n"), F.col("y.p")))
    return pairs.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()


def _graph(text: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(each row's signature, nodes, their components' roots) of text: doc_id, text, text_key."""
    spark = text.sparkSession
    first = cut(text.mapInArrow(partial(_signed, words=words), SIGNED))
    sketch = spark.sparkContext.broadcast(_sketch(first))
    signed = first.filter("slice is null").select("doc_id", "text_key", "n", "na", "nb", "bins")
    nodes = signed.filter("n > 0").groupBy("n", "na", "nb").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.first("bins").alias("bins"), F.count(F.lit(1)).alias("w"))
    nodes = cut(nodes.select("n", "na", "nb", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"), "bins", "w").withColumn("nid", F.monotonically_increasing_id()))

    # A node goes by the first half of its signature here, and by its size; the few that share both are told apart on verifying.
    prefix = text.select("text").mapInArrow(partial(_prefixes, words=words, percent=percent, sketch=sketch), "token long, na long, at long, salts int").withColumn("salt", F.pmod("na", "salts"))
    by = W.partitionBy("token", "salt").orderBy("at", "na")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct("na", F.col("at").bitwiseAND(0xFFFFFFFF).alias("n"))
    shared = prefix.withColumns({"lo": F.first(here).over(whole), "hi": F.last(here).over(whole), "held_by": F.count(F.lit(1)).over(whole), "before": F.lag(here).over(by)})
    shared = shared.filter(((F.col("salts") > 1) | (F.col("lo") != F.col("hi"))) & (F.col("before").isNull() | (F.col("before") != here)))
    shared = shared.select("token", "at", "na", "salts", "salt", F.shiftright("at", 32).cast("int").alias("p"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("n"), ((F.col("salts") == 1) & (F.col("held_by") <= FEW)).alias("few"))
    prior = F.collect_list(F.struct("na", "n", "p")).over(by.rowsBetween(-FEW, -1))
    prior = F.filter(prior, lambda x: F.col("few") & ((x["na"] != F.col("na")) | (x["n"] != F.col("n"))) & _may_link(percent, F.col("n"), F.col("p"), x["n"], x["p"]))
    shared = cut(shared.withColumn("prior", prior).filter((F.size("prior") > 0) | ~F.col("few")).drop("at"))

    key, other = nodes.select("na", "n", "nid"), nodes.select(F.col("na").alias("ma"), F.col("n").alias("mn"), F.col("nid").alias("mid"))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    few = shared.select("na", "n", F.explode("prior").alias("x")).select("na", "n", F.col("x.na").alias("ma"), F.col("x.n").alias("mn")).distinct()
    few = few.join(key, ["na", "n"]).join(other, ["ma", "mn"]).select(*ordered(F.col("nid"), F.col("mid")))
    held = cut(shared.filter(~F.col("few")).select("token", "salt", "salts", "na", "n", "p").join(key, ["na", "n"]).select("token", "salt", "salts", "nid", "n", "p"))
    earliest = held.groupBy("token", "salts").agg(F.min(F.struct("p", "n", "nid")).alias("e"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    earliest = earliest.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "e")
    star = held.join(earliest, ["token", "salt"]).filter((F.col("nid") != F.col("e.nid")) & _may_link(percent, F.col("n"), F.col("p"), F.col("e.n"), F.col("e.p")))
    star = cut(star.select(*ordered(F.col("nid"), F.col("e.nid"))).unionByName(few).distinct())
    roots = components(cut(_verified(star, nodes, text, words, percent)))

    marked = held.join(roots, held["nid"] == roots["node"], "left").select("token", "nid", "n", "p", F.coalesce("root", "nid").alias("root"))
    pairs = cut(_across(marked, percent).join(star, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = cut(_verified(pairs, nodes, text, words, percent))
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return signed, nodes, roots


def _text_of(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def ngram_join(docs: DataFrame, words: int = 3, percent: int = 90, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, and with links also n_links, for each row of docs (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest doc_id that
    links reach; n_links is how many other rows the row links with. A text without words, null included, has the empty set and links
    with nothing. Repeated rows are equal texts, which link. Null doc_ids take part and count as no id. Texts are read whole, a very
    long one (or a very long word) too; its set is held in one task. An empty table gives an empty result; other columns, whatever
    their names, aren't looked at.
    """
    text = _text_of(docs)
    signed, nodes, roots = _graph(text, words, percent)
    if not links:
        return _classed(signed, nodes.withColumn("n_links", F.lit(0)), roots).drop("n_links")
    return _classed(signed, nodes.join(_n_links(nodes, roots, text, words, percent), "nid", "left"), roots)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text, null as empty) of what stays when one text of each component does.

    That is the text of the smallest doc_id (null ids last), of several under one id the one of the smallest text_key. Texts without
    words link with nothing, so all of them stay. A pair that stands for several equal rows is given once.
    """
    signed, nodes, roots = _graph(_text_of(docs), words, percent)
    classed = nodes.join(roots, nodes["nid"] == roots["node"], "left")
    least = classed.groupBy(F.coalesce("root", "nid").alias("root")).agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_key")).alias("x"))
    return least.select(F.col("x.rep").alias("doc_id"), F.col("x.rep_key").alias("text_key")).unionByName(signed.filter("n = 0").select("doc_id", "text_key").distinct())


def _classed(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    classed = nodes.join(roots, nodes["nid"] == roots["node"], "left").select("na", "nb", "rep", F.coalesce("root", "nid").alias("root"), (F.col("w") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    least = classed.groupBy("root").agg(F.min("rep").alias("component"))
    known = cut(classed.join(least, "root").select("na", "nb", "component", "n_links"))
    out = signed.select("doc_id", "n", "na", "nb").join(known, ["na", "nb"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
