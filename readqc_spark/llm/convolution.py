"""Fitting that the two convolutional classifiers share: labelled samples, a logistic head and Adam, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a model is fitted on, the longest text among them, and all their texts together, in characters.
SAMPLE, LONGEST, TOGETHER = 6000, 200_000, 32_000_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, n: int, longest: int = LONGEST, together: int = TOGETHER, *more: str):
    """(texts as UTF-8, labels 0/1, *more) of labelled rows outside the held-out fold, by the hash of their ids: the first n at most.

    Texts above longest characters aren't taken, nor any from where all would be above together characters: what comes to the driver is
    bounded. Of several rows of one id and text one is taken. First ids and sizes are looked at, then the texts are fetched.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(fold(F.col("doc_id"), parts) != held)
    chosen = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *[docs[c] for c in more])
    text = text.withColumns({"n": F.length("text"), "digest": F.xxhash64("text")})
    some = text.filter(F.col("n") <= longest).select("doc_id", "digest", "n").join(F.broadcast(chosen), "doc_id").distinct()
    rows, total, taken = some.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(n).collect(), 0, {}
    for r in rows:
        total += r["n"]
        if total > together:
            break
        taken.setdefault((r["doc_id"], r["digest"]), (len(taken), r["label"]))
    wanted = docs.sparkSession.createDataFrame([(*k, *v) for k, v in taken.items()], "doc_id long, digest long, at long, label int")
    got = text.join(F.broadcast(wanted), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("at", "text", "label", *more).toArrow().sort_by("at")
    return [t.encode("utf-8", "surrogatepass") for t in got["text"].to_pylist()], (np.array(got["label"].to_pylist(), float) > 0).astype(np.float64), *[got[c].to_pylist() for c in more]


class Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
