"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed digest. A copy of a document gets a virtual finish time: the words of its
source up to and with it, divided by the source's target. All copies are put in the order of these times and taken until the
total budget is used. No step needs a source or the whole order in one task: rows alike are counted first, running sums are taken
within 4,096 buckets of the shuffle key and added up over the buckets, and the place where the budget ends is found by halving
ranges of finish time until few copies are left, or such as have one and the same time (one for each source and epoch at most).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readqc_spark.llm.common import WORD, cut, id_text, repeated

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: The targets of so many sources at most are found on the driver; those of more by aggregates over the table of sources.
FEW_SOURCES = 10_000
BUCKETS, LAST_STEP = 4096, 50_000


def targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Budget shared by weight; no share above cap times its size, the excess shared again by weight."""
    out, left, free = [0.0] * len(sizes), budget, [i for i, s in enumerate(sizes) if s > 0]
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole >= cap * sizes[i]]
        for i in over or free:
            out[i] = cap * sizes[i] if over else left * weights[i] / whole
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sums: DataFrame, total: int, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """rank, source_name, source_size, target of the sources in sums (source, n): targets(), for a table of any length."""
    placed = cut(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    per = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    first = placed.sparkSession.createDataFrame([(p, sum(n for q, n in per if q < p)) for p, _ in per], "p long, first long")
    ranked = placed.join(F.broadcast(first), F.shiftright("at", 33) == F.col("p")).withColumn("rank", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    dim = cut(ranked.select("rank", F.col("source").alias("source_name"), F.col("n").alias("source_size"), weight.alias("w"), F.when(F.col("n") == 0, F.lit(0.0)).alias("target")))
    left = budget
    while whole := dim.filter("target is null").agg(F.sum("w")).first()[0]:
        share, limit = F.lit(left) * F.col("w") / F.lit(whole), F.lit(cap) * F.col("source_size")
        over = F.col("target").isNull() & (share >= limit)
        used = dim.filter(over).agg(F.sum("source_size")).first()[0]
        if used is None:
            return dim.select("rank", "source_name", "source_size", F.coalesce("target", share).alias("target"))
        dim, left = cut(dim.withColumn("target", F.when(over, limit).otherwise(F.col("target")))), left - cap * used
    return dim.select("rank", "source_name", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, row_key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_finish for each row of docs (doc_id, text, source).

    Size is the number of words, 0 for null and empty texts, of which nothing is taken. A null source is one of its own, after all
    others. taken is size times the number of copies (up to epochs) that fall into the budget. Ties in the order are settled by
    source, shuffle key (of doc_id and text), doc_id, size and epoch; rows alike in all of these are interchangeable. Very long texts
    count whole. An empty table gives an empty result; other columns, whatever their names, aren't looked at. row_key: a string for
    each row of docs, given back as row_key, by which rows can be told apart.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), id_text(docs["doc_id"].cast("long")), F.lit(":"), F.md5(text)))
    marked = F.lit("") if row_key is None else row_key
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text).alias("size"), key.alias("key"), marked.alias("row_key"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "key", "row_key").agg(F.count(F.lit(1)).alias("m")))
    sums = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("n")))
    total, n_sources = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    budget = share * total
    if n_sources <= FEW_SOURCES:
        found = sorted(sums.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        goal = targets([r["n"] for r in found], [weights[i % len(weights)] for i in range(len(found))], budget, float(epochs))
        dim = F.broadcast(spark.createDataFrame([(i, r["source"], r["n"], goal[i]) for i, r in enumerate(found)], "rank long, source_name string, source_size long, target double"))
    else:
        dim = _targets(sums, total, weights, budget, float(epochs))
    keyed = rows.join(dim, rows["source"].eqNullSafe(F.col("source_name"))).select("doc_id", "size", "rank", "source_size", "target", "key", "row_key", "m", F.substring("key", 1, 3).alias("bucket"))
    here = F.col("size") * F.col("m")
    sums = keyed.groupBy("rank", "bucket").agg(F.sum(here).alias("n"))
    before = sums.select("rank", "bucket", (F.sum("n").over(W.partitionBy("rank").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.sum(here).over(W.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size", "row_key").rowsBetween(W.unboundedPreceding, 0)) - here
    each = repeated(keyed.withColumn("own", own).join(before, ["rank", "bucket"]), "m", "number")
    ends = F.col("before") + F.col("own") + F.col("size") * (F.col("number") + 1)
    queued = cut(each.withColumn("finish", F.when(F.col("target") > 0, ends / F.nullif(F.col("target"), F.lit(0.0)))).drop("bucket", "before", "own", "m", "number"))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    copies = queued.filter("size > 0 and target > 0").select("rank", "key", "doc_id", "size", epoch.alias("epoch"), "finish", "source_size", "target").withColumn("time", F.col("finish") + F.col("epoch") * (F.col("source_size") / F.nullif(F.col("target"), F.lit(0.0))))
    last = _cutoff(copies, budget)
    order = ["time", "rank", "key", "doc_id", "size", "epoch"]
    taken = F.lit(0)
    if last is not None:
        for e in range(epochs):
            time = F.col("finish") + F.lit(e) * (F.col("source_size") / F.nullif(F.col("target"), F.lit(0.0)))
            here = F.struct(time.alias("time"), "rank", "key", "doc_id", "size", F.lit(e).alias("epoch"))
            there = F.struct(*[F.lit(last[c]).cast(copies.schema[c].dataType).alias(c) for c in order])
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (here <= there), 1).otherwise(0)
    out = queued.select("doc_id", "size", "source_size", "target", (F.col("size") * taken).alias("taken"), taken.cast("int").alias("copies"), F.col("finish").alias("first_finish"), "row_key")
    return out.drop("row_key") if row_key is None else out


def _cutoff(copies: DataFrame, budget: float):
    """The last copy, in queue order, with which the running sum of sizes is within budget; None if there is none."""
    low, high, used = 0.0, None, 0
    for _ in range(12):
        here = copies.filter((F.col("time") >= low) & (F.lit(True) if high is None else F.col("time") < high))
        if high is None:
            high = here.agg(F.max("time")).first()[0]
            if high is None:
                return None
            high = math.nextafter(high, math.inf)
        step = (high - low) / BUCKETS
        if not step or low + step == low:
            break
        each = here.groupBy(F.least(F.floor((F.col("time") - low) / step), F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("time").alias("a"), F.max("time").alias("z")).orderBy("b").collect()
        hit = None
        for r in each:
            if used + r["n"] > budget:
                hit = r
                break
            used += r["n"]
        if hit is None:
            low = max(r["a"] for r in each)
            used -= each[-1]["n"]
            break
        first = hit is each[0] or hit["b"] == each[0]["b"]
        if not first:  # the last copy of all may stand just before this bucket
            prior = each[[r["b"] for r in each].index(hit["b"]) - 1]
            used -= prior["n"]
            low, high, rows = prior["a"], math.nextafter(hit["z"], math.inf), prior["rows"] + hit["rows"]
        else:
            low, high, rows = hit["a"], math.nextafter(hit["z"], math.inf), hit["rows"]
        if rows <= LAST_STEP:
            break
    here = copies.filter((F.col("time") >= low) & (F.col("time") < high))
    order = ["time", "rank", "key", "doc_id", "size", "epoch"]
    summed = here.withColumn("sum", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + F.lit(used))
    return summed.filter(F.col("sum") <= F.lit(budget)).orderBy(*[F.desc(c) for c in order]).first()
