"""Quality by a byte-level convolutional network: filters over overlapping chunks of the whole text, max-pooled and combined.

A filter looks at TAPS pairs of bytes, at every byte offset. As bytes have embeddings, what a filter makes of a pair is a table of
65,536 rows, so a text is scored by TAPS lookups for each byte. Each chunk of CHUNK places (OVERLAP of them shared with the next)
gives the largest answer of each filter; the mean and the maximum of these over the chunks make one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import parts_of, texts
from readqc_spark.llm.convolution import LONGEST, SAMPLE, TOGETHER, Adam, fold, sample, sigmoid

TAPS, DIM, FILTERS, CHUNK, OVERLAP = 3, 6, 8, 1024, 64
WIDE = 2 * TAPS - 1  # pairs from a filter's first place to its last
FOLDS, HELD, LEAST = 4, 2, 0.7


def pairs_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the pair of bytes at each place of all texts, first place of each text and the end). Short texts are padded with zeros to 2 * TAPS bytes."""
    padded = [b + bytes(max(2 * TAPS - len(b), 0)) for b in parts]
    flat = np.frombuffer(b"".join(padded) + b"\0", np.uint8).astype(np.int32)
    return flat[:-1] << 8 | flat[1:], np.concatenate([[0], np.cumsum([len(b) for b in padded])])


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first and end of each chunk's filter places, number of chunks of each text)."""
    bounds, counts = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        last = b - WIDE
        starts = list(range(a, max(a + 1, last - OVERLAP), CHUNK - OVERLAP))
        bounds += [(s, min(s + CHUNK, last)) for s in starts]
        counts.append(len(starts))
    return np.array(bounds, np.int64).reshape(-1, 2), np.array(counts, np.int64)


def answers(lookup: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What the filters say at each place."""
    n = len(pairs) - WIDE
    out = lookup[0][pairs[:n]]
    for k in range(1, TAPS):
        out += lookup[k][pairs[2 * k : 2 * k + n]]
    return out


def tables(model: dict) -> np.ndarray:
    """What the filters make of each pair at each tap: (TAPS, 65536, FILTERS)."""
    e, w = model["bytes"], model["filters"].reshape(TAPS, 2, DIM, FILTERS)
    return np.stack([((e @ w[k, 0])[:, None, :] + (e @ w[k, 1])[None, :, :]).reshape(65536, FILTERS) for k in range(TAPS)]).astype(np.float32)


def pooled(lookup: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The largest answer of each filter in each chunk."""
    out = np.concatenate([answers(lookup, pairs), np.zeros((1, FILTERS), np.float32)])
    return np.maximum.reduceat(out, bounds.ravel(), axis=0)[::2]


def features(model: dict, most: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means and maxima over each text's chunks, positive parts of the chunks' answers)."""
    act = np.maximum(most + model["shift"], 0)
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.concatenate([np.add.reduceat(act, at) / counts[:, None], np.maximum.reduceat(act, at)], 1), act


def scores(model: dict, lookup: np.ndarray, parts: list[bytes]) -> np.ndarray:
    pairs, first = pairs_of(parts)
    bounds, counts = chunks_of(first)
    return sigmoid(features(model, pooled(lookup, pairs, bounds), counts)[0] @ model["out"] + model["bias"])


def fit(raw: list[bytes], labels: np.ndarray, epochs: int = 12, seed: int = 11) -> dict:
    """The model as a dictionary of arrays. Without both labels, every score is the share of label 1."""
    rng, share = np.random.default_rng(seed), float(labels.mean()) if len(labels) else 0.0
    model = {"bytes": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, 0.3, (2 * TAPS, DIM, FILTERS)), "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 2 * FILTERS), "bias": np.full(1, np.log((share + 1e-6) / (1 - share + 1e-6)))}
    if not 0 < share < 1:
        return model | {"out": np.zeros(2 * FILTERS)}
    names = ["bytes", "filters", "shift", "out", "bias"]
    adam, weight = Adam([model[n] for n in names], 0.02), np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        adam.rate = 0.02 if epoch < epochs * 2 // 3 else 0.005
        for some in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // 64)):
            pairs, first = pairs_of([raw[i] for i in some])
            bounds, counts = chunks_of(first)
            byte, n = pairs >> 8, len(pairs) - WIDE
            small = (model["bytes"][None] @ model["filters"]).astype(np.float32)
            said = small[0][byte[:n]]
            for k in range(1, 2 * TAPS):
                said += small[k][byte[k : k + n]]
            picks = np.stack([a + said[a:b].argmax(0) for a, b in bounds])
            most = np.take_along_axis(said, picks, 0)
            feat, act = features(model, most, counts)
            d = (sigmoid(feat @ model["out"] + model["bias"]) - labels[some]) * weight[some] / len(some)
            owner = np.repeat(np.arange(len(some)), counts)
            back = d[:, None] * model["out"][None, :]
            g = back[owner, :FILTERS] / counts[owner, None] + back[owner, FILTERS:] * (act == feat[owner, FILTERS:])
            g *= act > 0
            grads = {"bytes": np.zeros_like(model["bytes"]), "filters": np.zeros_like(model["filters"]), "shift": g.sum(0), "out": feat.T @ d, "bias": d.sum(keepdims=True)}
            for k in range(2 * TAPS):
                pair = pairs[picks + k // 2 * 2]
                byte = pair >> 8 if k % 2 == 0 else pair & 255
                grads["filters"][k] = np.einsum("cfd,cf->df", model["bytes"][byte], g)
                np.add.at(grads["bytes"], byte.ravel(), (g[:, :, None] * model["filters"][k].T[None]).reshape(-1, DIM))
            adam.step([grads[x] for x in names])
    return model


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lookup = tables(model.value)
    for b in batches:
        got = [scores(model.value, lookup, [t for _, t in some]) for some in parts_of(b["text"], 1 << 18)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame, n: int = SAMPLE // 2, longest: int = LONGEST, together: int = TOGETHER // 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text). predicted: the score is 0.7 or more.

    Fitted on at most n rows of labels (doc_id, quality) outside fold 2 of 4, of texts of at most longest characters and of together
    characters in all. Null and empty texts are scored as a few zero bytes, very long ones whole. Repeated rows each get their row.
    Without labels, or with one label only, scores are constant. An empty table gives an empty result; other columns aren't looked at.
    """
    text, marks = sample(docs, labels, "quality", FOLDS, HELD, n, longest, together)
    model = docs.sparkSession.sparkContext.broadcast(fit(text, marks))
    got = texts(docs).mapInArrow(partial(_scored, model=model), "doc_id long, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
