"""What both networks answer against loops over words and bytes, and what their samples hold."""

import os
import subprocess
import sys

import numpy as np
import pytest

from readqc_spark.llm import convolution, quality, toxicity
from readqc_spark.llm.common import word_hashes


def texts():
    r = np.random.default_rng(5)
    words = ["tree", "Häuser", "vile", "x", "日本", "a" * 300]
    return [" ".join(r.choice(words, r.integers(0, 900))).encode() for _ in range(40)] + [b"", b" ", b"!", b"q" * 5000]


def test_toxicity_word_by_word():
    some = texts()
    model = toxicity.fit(some, np.array([i % 3 == 0 for i in range(len(some))], float), ["en"] * len(some), epochs=2)
    for text, got in zip(some, toxicity.scores(model, some), strict=True):
        hashes, _ = word_hashes([text], toxicity._PARTING)
        rows = [[int(h) >> t * toxicity.BITS & (1 << toxicity.BITS) - 1 for t in range(toxicity.TABLES)] for h in hashes] or [[toxicity.PAD] * toxicity.TABLES]
        x = [np.concatenate([model["table"][t][r[t]] for t in range(toxicity.TABLES)]) for r in rows] + [np.zeros(toxicity.TABLES * toxicity.DIM)] * 2
        best = []
        for w in toxicity.WIDTHS:
            best += [max(model[f"b{w}"][f] + sum(float(x[i + k] @ model[f"w{w}"][k][:, f]) for k in range(w)) for i in range(len(rows))) for f in range(toxicity.FILTERS)]
        assert got == pytest.approx(1 / (1 + np.exp(-(np.maximum(best, 0) @ model["out"] + model["bias"][0]))), abs=1e-5)


def test_quality_byte_by_byte():
    some = texts()[:12] + [b"", b"!", b"ab" * 1500]
    model = quality.fit(some, np.array([i % 3 == 0 for i in range(len(some))], float), epochs=2)
    for text, got in zip(some, quality.scores(model, quality.tables(model), some), strict=True):
        e = model["bytes"][list(text + bytes(max(0, 2 * quality.TAPS - len(text))))]
        n = len(e) - 2 * quality.TAPS + 1
        said = sum(e[k : k + n] @ model["filters"][k] for k in range(2 * quality.TAPS))
        most, a = [], 0
        while True:
            most.append(np.maximum(said[a : a + quality.CHUNK].max(0) + model["shift"], 0))
            a += quality.CHUNK - quality.OVERLAP
            if a >= n - quality.OVERLAP:
                break
        feature = np.concatenate([np.mean(most, 0), np.max(most, 0)])
        assert got == pytest.approx(1 / (1 + np.exp(-(feature @ model["out"] + model["bias"][0]))), abs=1e-4)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, "ab" * (i % 50), "en") for i in range(100)] + [(60, "z" * 5000, "en"), (None, "z", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(60, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got, marks, langs = convolution.sample(docs, labels, "toxic", 5, 0, 1000, 1000, 600, "lang")
    assert 0 < sum(map(len, got)) <= 600 and len(got) == len(set(got)) == len(marks) == len(langs)
    assert all(m == len(t) // 2 % 2 for t, m in zip(got, marks, strict=True))
    assert len(convolution.sample(docs, labels, "toxic", 5, 0, 7)[0]) in (6, 7)


FIT = """
import re
from functools import partial
from types import SimpleNamespace as N
import numpy as np, pyarrow as pa
from readqc_spark.llm import toxicity
held = lambda: sum(map(int, re.findall("Pss_Anon: *([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10
def sample(*_):
    rows = pa.table({"text": [f"word{i % 97} of text{i} " * 400 for i in range(4000)]}).sort_by("text")
    return [t.encode() for t in rows["text"].to_pylist()], np.arange(4000) % 2.0, ["en"] * 4000
toxicity.sample, toxicity.fit, toxicity.lean = sample, partial(toxicity.fit, epochs=1), lambda _: None
session, before = N(sparkContext=N(broadcast=lambda model: model)), held()
model = toxicity.fitted(N(sparkSession=session), None)
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads memory from /proc")
def test_fitting_leaves_no_texts_in_the_driver():
    path = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", FIT], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout.split()[-1]) < 80  # MB: 40 with memory given back (the model and what libraries load), 178 without
