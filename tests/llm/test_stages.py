"""Each stage of the pipeline alone: repeated and null ids, empty tables, clashing and odd names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from readqc_spark.llm import mixing, pieces

SCHEMA = "doc_id long, text string, lang string, source string, _sha int, row string, `a.b` int, row_key string, score double, _n int"
WORDS = [f"w{k}" for k in range(60)]
NEAR = [" ".join([*WORDS[:k], "other", *WORDS[k + 1 :]]) for k in (5, 50)]
ROWS = [(5, " ".join(WORDS), "a"), (5, NEAR[0], "a"), (5, "wholly different text of its own", "b"), (None, NEAR[1], "b"), (None, "one", None), (None, "one", "a"), (7, "one", "a"), (7, "one", "a"), (8, None, "a"), (9, "", "b"), (10, "x y z", "a"), (10, "p q r", "b"), (11, "long " * 20000, "c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, "r", k, "key", 0.25, 3) for k, (i, t, s) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def run(stage, spark, rows, sf_dir):
    docs = frame(spark, rows)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert all((r["_sha"], r["row"], r["row_key"], r["score"], r["_n"]) == (7, "r", "key", 0.25, 3) for r in got)
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in got), key=str)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_empty(spark, labels, stage):
    assert stage(spark, frame(spark, []), labels).count() == 0


def test_toxicity(spark, labels):
    assert run(cp.toxicity_stage, spark, ROWS, labels) == sorted(ROWS, key=str)


def test_exact(spark, labels):
    got = run(cp.exact_stage, spark, ROWS, labels)
    assert Counter(t or "" for _, t, _ in got) == Counter({t or "" for _, t, _ in ROWS})
    assert (7, "one", "a") in got and (9, "", "b") in got and (5, NEAR[0], "a") in got


def test_near(spark, labels):
    got = run(cp.near_stage, spark, ROWS, labels)
    assert len([1 for _, t, _ in got if t in (" ".join(WORDS), *NEAR)]) == 1 and (None, NEAR[1], "b") not in got
    assert (5, "wholly different text of its own", "b") in got and [r for r in got if r[1] == "one"] == [(7, "one", "a")]
    assert (8, None, "a") in got and (9, "", "b") in got and (10, "x y z", "a") in got and (10, "p q r", "b") in got


def test_mixing(spark, labels):
    rows = ROWS + [(3, f"{'a ' * (i % 5)}b", f"s{i % 2}") for i in range(200)]
    taken = mixing.mix(frame(spark, rows)).groupBy("size").agg(F.sum("copies").alias("n")).collect()
    got = run(cp.mixing_stage, spark, rows, labels)
    assert Counter(len((t or "").split()) for _, t, _ in got) == Counter({r["size"]: r["n"] for r in taken if r["n"]})
    most = Counter(rows)
    assert all(n <= 2 * most[r] for r, n in Counter(got).items())


def queue(rows, weights=(3, 1, 2), share=1.5, epochs=2, seed="mix-1"):
    """The mix by a plain queue: (doc_id, size, source size, target, taken)."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(i, len((t or "").split()), s, md5(f"{seed}:{'null' if i is None else i}:{md5(t or '')}")) for i, t, s in rows]
    sources = sorted({s for _, _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(n for _, n, s, _ in rows if s == x) for x in sources]
    goal, budget = mixing.targets(size, [weights[k % 3] for k in range(len(sources))], share * sum(size), epochs), share * sum(size)
    line, out = [], []
    for k, x in enumerate(sources):
        run = 0
        for i, n, _, key in sorted((r for r in rows if r[2] == x), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1])):
            run += n
            out.append([i, n, size[k], goal[k], 0])
            line += [(run / goal[k] + e * (size[k] / goal[k]), k, key, i is not None, i or 0, n, e, len(out) - 1) for e in range(epochs) if n and goal[k]]
    used = 0
    for *_, n, _, at in sorted(line):
        used += n
        if used > budget:
            break
        out[at][4] += n
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("few", [10_000, 0])
def test_mix_against_a_plain_queue(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    r = random.Random(few)
    rows = ROWS + [(r.choice([None, *range(40)]), " ".join("w" * r.randrange(0, 9)) if r.random() < 0.9 else None, r.choice([None, "a", "b", "é", "z", "𝒳"])) for _ in range(600)] + [(1, "same text here", "hot")] * 400
    got = mixing.mix(frame(spark, rows))
    want = queue(rows)
    assert sorted((tuple(x)[:5] for x in got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == want


def test_pieces(spark, labels):
    got = cp.pieces_stage(spark, frame(spark, ROWS), labels).collect()
    m = pieces.Pieces(open(pieces.MODEL, "rb").read())
    by: dict = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["chunk"])):
        if r["doc_id"] == 11:
            by.setdefault(11, []).extend(r["ids"])
    assert by[11] == m.sp.encode("long " * 20000) and sum(r["chunk"] == 0 for r in got) == len(ROWS)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
