"""Base spans against Python's re on hostile strings; texts of very many matches; cleaned texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from readqc_spark.llm import private_data


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def hostile(n):
    r = random.Random(11)
    parts = ["a", "b@", "@", ".", "..", "-", " ", "+", "%", "1", "255", "256", "0", "00", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "x@y.z", "é", "😀", "\n", "10.0.0.1", "1.2.3.4.5", "(", ")", "_", "A.b+c@d-e.f.g"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_base_spans(spark):
    some = hostile(6000)
    got = spark.createDataFrame(list(enumerate(some)), "k int, text string").select("k", private_data.base_spans(F.col("text")).alias("s")).collect()
    for r in got:
        assert [(s["start"], s["rank"], s["end"]) for s in r["s"]] == base(some[r["k"]]), some[r["k"]]


def test_very_many_matches(spark):
    text = " ".join(f"u{k}@example{k}.org" for k in range(8000))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    r = private_data.digest(private_data.find_private(one)).first()
    assert r["n_email"] == 8000 and r["spans"] == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text))
    assert r["clean_sha256"] == hashlib.sha256(" ".join(["[EMAIL]"] * 8000).encode()).hexdigest()
    assert time.monotonic() - began < 60


def test_cleaned(spark):
    rows = [(None, "call +1 (555) 123-4567 now"), (3, "nothing"), (3, "ü x@y.org 10.0.0.1"), (3, "ü x@y.org 10.0.0.1"), (4, None), (5, "+1 4111 1111 1111 1111 1 end")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], r["text"]) for r in private_data.sanitise(docs).collect()), key=str)
    want = [(None, "call [PHONE] now"), (3, "nothing"), (3, "ü [EMAIL] [IP]"), (3, "ü [EMAIL] [IP]"), (4, "")]
    assert [x for x in got if x[0] != 5] == sorted(want, key=str)
    told = {(r["doc_id"], r["clean_sha256"]) for r in private_data.find_private(docs).collect()}
    assert told == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got}
