"""Toxicity by a convolutional text classifier: hashed word embeddings, filters over one to three words, max pooling.

Words are runs of letters and digits. A word has a row in each of TABLES embedding tables, by independent parts of its hash, so that
a word that shares one row with a toxic word doesn't share the others. Embeddings begin with the log-odds of their rows' words in the
sample. A text of any length is scored whole: its features are the largest answers of each filter anywhere in it. Thresholds are set
for each language on the sample; a language is never an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import give_back, lean, parts_of, quoted, word_hashes
from readqc_spark.llm.convolution import LONGEST, SAMPLE, TOGETHER, Adam, fold, sample, sigmoid

BITS, TABLES, DIM, FILTERS, WIDTHS, PRIOR = 17, 2, 4, 4, (1, 2, 3), 30.0
FOLDS, HELD = 5, 0
_PARTING = np.ones(256, bool)
_PARTING[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PAD = 1 << BITS


def rows_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows of each word, first and end of each text there). Texts are three padding rows apart; one without words is padding."""
    hashes, counts = word_hashes(parts, _PARTING)
    sizes = np.maximum(counts, 1)
    first = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
    out = np.full((int((sizes + 2).sum()), TABLES), PAD, np.int32)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(len(hashes))
    for t in range(TABLES):
        out[at, t] = (hashes >> np.uint64(t * BITS)) & np.uint64((1 << BITS) - 1)
    return out, first, first + sizes


def answers(model: dict, x: np.ndarray, w: int) -> np.ndarray:
    """What the filters of a width say at each word; x: the words' embeddings, with two rows of padding after the last text."""
    n = len(x) - w + 1
    out = x[:n] @ model[f"w{w}"][0]
    for k in range(1, w):
        out += x[k : k + n] @ model[f"w{w}"][k]
    return out + model[f"b{w}"]


def embedded(model: dict, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([model["table"][t][rows[:, t]] for t in range(TABLES)], 1)


def scores(model: dict, parts: list[bytes]) -> np.ndarray:
    rows, first, end = rows_of(parts)
    x, best = embedded(model, rows), []
    bounds = np.stack([first, end], 1).ravel()
    for w in WIDTHS:
        a = answers(model, x, w)
        best.append(np.maximum.reduceat(np.concatenate([a, np.zeros((1 + len(x) - len(a), FILTERS), a.dtype)]), bounds, axis=0)[::2])
    return sigmoid(np.maximum(np.concatenate(best, 1), 0) @ model["out"] + model["bias"])


def fit(texts: list[bytes], labels: np.ndarray, langs: list | None = None, epochs: int = 8, seed: int = 7) -> dict:
    """The model as a dictionary of arrays, and thresholds by language. Without both labels, every score is the share of label 1.

    Every fifth text is kept out of the fit; with langs, the thresholds are set on these.
    """
    kept = np.arange(len(texts)) % 5 == 4
    model = _fit([t for t, k in zip(texts, kept, strict=True) if not k], labels[~kept], epochs, seed)
    apart = [i for i in np.flatnonzero(kept)] if langs else []
    model["thresholds"] = thresholds(model, [texts[i] for i in apart], labels[apart], [langs[i] for i in apart]) if apart and model["fitted"] else {}
    return model


def _slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > limit:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _fit(texts: list[bytes], labels: np.ndarray, epochs: int, seed: int) -> dict:
    rng, width = np.random.default_rng(seed), TABLES * DIM
    share = float(labels.mean()) if len(labels) else 0.0
    each = []
    for some in _slices(texts):
        rows, first, end = rows_of(some)
        each += [rows[a:b] for a, b in zip(first, end, strict=True)]
    table = (rng.normal(0, 0.02, (TABLES, PAD + 1, DIM))).astype(np.float32)
    table[:, PAD] = 0
    for t in range(TABLES):
        seen = np.zeros((2, PAD + 1))
        for r, y in zip(each, labels, strict=True):
            seen[int(y), np.unique(r[:, t])] += 1
        n1, n0 = max(labels.sum(), 1e-9), max((1 - labels).sum(), 1e-9)
        odds = np.log((seen[1] + PRIOR * share + 1e-9) / n1) - np.log((seen[0] + PRIOR * (1 - share) + 1e-9) / n0)
        table[t, :PAD, 0] += np.where(seen.sum(0) > 0, odds, 0)[:PAD] if 0 < share < 1 else 0
    model = {"table": table, "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS) + 0.2, "bias": np.full(1, -2.0), "fitted": 0 < share < 1}
    for w in WIDTHS:
        k = rng.normal(0, 0.1, (w, width, FILTERS))
        k[:, ::DIM] += 0.5 / w
        model |= {f"w{w}": k.astype(np.float32), f"b{w}": np.full(FILTERS, -1.0, np.float32)}
    if not 0 < share < 1:
        return model | {"out": np.zeros_like(model["out"]), "bias": np.full(1, np.log((share + 1e-6) / (1 - share + 1e-6)))}
    names = ["out", "bias", *[f"{c}{w}" for w in WIDTHS for c in "wb"]]
    adam = Adam([model[n] for n in names], 0.02)
    pad = np.full((2, TABLES), PAD, np.int32)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(each)), max(1, len(each) // 64)):
            rows = np.concatenate([x for i in some for x in (each[i], pad)])
            end = np.cumsum([len(each[i]) + 2 for i in some]) - 2
            first, x = end - [len(each[i]) for i in some], embedded(model, rows)
            picks, feats = [], []
            for w in WIDTHS:
                a = answers(model, x, w)
                at = np.stack([f + a[f:e].argmax(0) for f, e in zip(first, end, strict=True)])
                picks.append(at)
                feats.append(np.take_along_axis(a, at, 0))
            feat = np.maximum(np.concatenate(feats, 1), 0)
            d = (sigmoid(feat @ model["out"] + model["bias"]) - labels[some]) / len(some)
            grads = {"out": feat.T @ d, "bias": d.sum(keepdims=True)}
            back = d[:, None] * model["out"][None, :] * (feat > 0)
            for j, w in enumerate(WIDTHS):
                g = back[:, j * FILTERS : (j + 1) * FILTERS]
                grads[f"b{w}"], grads[f"w{w}"] = g.sum(0), np.empty(model[f"w{w}"].shape)
                for k in range(w):
                    grads[f"w{w}"][k] = np.einsum("nfd,nf->df", x[picks[j] + k], g)
                    move = 0.1 * len(some) / 64 * g[:, :, None] * model[f"w{w}"][k].T[None]
                    for t in range(TABLES):
                        np.subtract.at(model["table"][t], rows[picks[j] + k, t].ravel(), move[:, :, t * DIM : (t + 1) * DIM].reshape(-1, DIM).astype(np.float32))
            model["table"][:, PAD] = 0
            adam.step([grads[n].astype(model[n].dtype) for n in names])
    return model


def thresholds(model: dict, texts: list[bytes], labels: np.ndarray, langs: list, least: int = 20) -> dict:
    """For each language with enough of both labels, the threshold from 0.3 to 0.7, nearest 0.5, of the best F1."""
    out: dict = {}
    got = np.concatenate([scores(model, some) for some in _slices(texts)])
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        s, y = got[mine], labels[mine]
        if y.sum() >= least and (1 - y).sum() >= least:
            f1 = lambda t: 2 * ((s >= t) & (y > 0)).sum() / max(1, (s >= t).sum() + y.sum())  # noqa: E731, B023
            out[lang] = max((0.3 + 0.02 * k for k in range(21)), key=lambda t: (round(f1(t), 6), -abs(t - 0.5)))  # noqa: B023
    return out


def _scored(batches: Iterator[pa.RecordBatch], model, text: str, keep: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [scores(model.value, [t for _, t in some]) for some in parts_of(b.column(text), 1 << 19)]
        score = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
        yield (b if keep else b.drop_columns([text])).append_column("score", score)


def fitted(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, longest: int = LONGEST, together: int = TOGETHER):
    """The model, broadcast, fitted on at most n rows of labels (doc_id, toxic) outside fold 0 of 5; the other bounds are sample()'s."""
    lean(docs.sparkSession)
    text, marks, langs = sample(docs, labels, "toxic", FOLDS, HELD, n, longest, together, "lang")
    give_back()  # what the rows came in
    model = docs.sparkSession.sparkContext.broadcast(fit(text, marks, langs))
    del text, marks, langs
    give_back()
    return model


def threshold(model, lang: Column) -> Column:
    limit = F.lit(0.5)
    for name, t in sorted(model.value["thresholds"].items()):
        limit = F.when(lang == name, F.lit(float(t))).otherwise(limit)
    return limit


def toxicity(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, longest: int = LONGEST, together: int = TOGETHER) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged for each row of docs (doc_id, text, lang).

    predicted: the score is 0.5 or more; flagged: it is the language's threshold or more (0.5 for a null language or one with few
    labels). Fitted on at most n rows of labels (doc_id, toxic) outside fold 0 of 5, of texts of at most longest characters and of
    together characters in all. Null and empty texts are scored as texts without words, very long ones whole. Repeated rows each get
    their row. Without labels, or with one label only, scores are constant. An empty table gives an empty result; other columns aren't
    looked at.
    """
    model = fitted(docs, labels, n, longest, together)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    got = rows.mapInArrow(partial(_scored, model=model, text="text", keep=False), "doc_id long, lang string, score double")
    return got.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= threshold(model, F.col("lang"))).alias("flagged"))


def without_flagged(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text, lang, any others) that toxicity doesn't flag, in one pass without a shuffle."""
    model, columns = fitted(docs, labels, n), docs.columns
    packed = docs.select(docs["text"].cast("string").alias("_text"), F.struct(*[F.col(quoted(c)) for c in columns]).alias("_row"), docs["lang"].cast("string").alias("_lang"))
    plain = packed.select("_text", "_lang", *[F.col("_row").getField(c).alias(f"_c{k}") for k, c in enumerate(columns) if c != "text"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    got = plain.mapInArrow(partial(_scored, model=model, text="_text", keep=True), kinds).filter(~(F.col("score") >= threshold(model, F.col("_lang"))))
    return got.select(*[F.col("_text" if c == "text" else f"_c{k}").alias(c) for k, c in enumerate(columns)])
