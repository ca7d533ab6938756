import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readqc_spark.llm import convolution, exact_dedup, media, mixing, ngram_join, pieces, private_data, quality, token_shards, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, block int"
LONG = "lorem ipsum dolor sit amet consectetur " * 900


def rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    r = random.Random(3)
    base = [r.choice(words) for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    out = [(1, None, "en", None, 1), (2, "", None, "a", 1), (3, " \t", "en", "a", 1), (4, "one", "en", "a", 1), (5, "one", "fr", "b", 1), (6, LONG, "en", "b", 1), (7, " ".join(base), "en", "c", 1), (8, " ".join(near), "en", "c", 1), (9, " ".join(base[::-1]), "en", "b", 1)]
    return [*out, (9, " ".join(base[::-1]), "en", "b", 1), (10, "Ünï 😀 a@b.example.com 10.0.0.255 +1 (555) 123-4567 x 4111 1111 1111 1111", "es", "b", 1), (None, "one", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[4]["keep_id"] == 5 and by[4]["group_size"] == 3 and not by[4]["kept"] and by[5]["kept"] and by[1]["keep_id"] == 2
    assert sum(r["kept"] for r in got if r["doc_id"] == 9) == 1 and by[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0
    data = os.urandom(300_000)
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and set(exact_dedup.cut_points(b"x" * 7000 + data)[3:]) & {e + 7000 for e in ends}


def test_ngram_join(docs, empty):
    by = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    assert by[8]["component_id"] == 7 and by[9]["component_id"] == 9 and by[5]["component_id"] == 4 and by[None]["component_id"] == 4
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[3]["component_id"] == 3
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("leaves", [256, 4])
def test_large_group_of_near_copies(spark, monkeypatch, leaves):
    monkeypatch.setattr(ngram_join, "LEAVES", leaves)
    r = random.Random(1)
    base = [f"w{r.randrange(400)}" for _ in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(200), r.randrange(1, 6)):
            w[k] = f"n{i}x{k}"
        texts.append(w)
    sets = [{tuple(w[k : k + 3]) for k in range(198)} for w in texts]
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.ngram_join(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(120)}


@pytest.mark.parametrize("part, slab", [(128, 8192), (16, 64)])
def test_number_of_links_against_brute_force(spark, monkeypatch, part, slab):
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "SLAB", slab)
    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(200)]
    texts = ["", "of its own", None]
    for i in range(60):
        w = list(base)
        for k in r.sample(range(200), r.randrange(1, 6)):
            w[k] = f"n{i}x{k}"
        texts += [" ".join(w)] * (1 + (i % 7 == 0))
    ids = [None if i == 9 else i // 2 if 20 < i < 30 else i for i in range(len(texts))]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in ((t or "").split() for t in texts)]
    links = [sum(a != b and len(x) > 0 and 100 * len(x & y) >= 90 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    assert 0 < max(links) and len(set(links)) > 5
    # two rows of one id and one text look alike, so the rows are compared as a whole
    got = ngram_join.ngram_join(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), links=True).collect()
    assert sorted(((x["doc_id"], x["n_links"]) for x in got), key=str) == sorted(zip(ids, links, strict=True), key=str)


def test_near_copies_that_share_an_id(spark):
    base = [f"w{k}" for k in range(100)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 50, 80)]
    rows = [(5, " ".join(base)), (5, near[0]), (None, near[1]), (None, near[1]), (3, near[2]), (5, "none of these words")]
    got = [tuple(x) for x in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 98, 3), (5, 98, 3), (None, 98, 3), (None, 98, 3), (3, 98, 3), (5, 2, 5)], key=str)


def test_components_at_once_and_in_rounds(spark, monkeypatch):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(9000 - k, 8999 - k) for k in range(50)] + [(7, 500), (500, 3), (3, 3), (1 << 40, 7), (7, 500)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(130)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want, df = {(x, y) for x, y in root.items() if x != y}, spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("components-at-once", "")
    assert sorted(tuple(x) for x in ngram_join.components(df).collect()) == sorted(want)
    assert ngram_join.components(df.filter("a = b")).count() == 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-at-once")) <= 20  # each of several rounds would take a dozen
    spark.sparkContext.setJobGroup("other", "")
    monkeypatch.setattr(ngram_join, "AT_ONCE", 0)
    assert sorted(tuple(x) for x in ngram_join.components(df).collect()) == sorted(want)


def test_disclosing_terms_against_brute_force(spark):
    r, names = random.Random(5), "anna bert carl dora emil fritz gerda".split()
    texts = [" ".join(r.choice([names[i % 7], r.choice(names), "the", "and", "house"]) for _ in range(6)) for i in range(60)]
    near = [(i, f"e{i % 7}", w) for i, t in enumerate(texts) for w in sorted({*t.split()[:2]})]
    told = private_data.disclosing(spark.createDataFrame(near, "row long, entity string, term string"), spark.createDataFrame([(t,) for t in texts], "text string"), 60, 2, 0.3)
    want = set()
    for e, w in {(e, w) for _, e, w in near}:
        both = sum(x[1:] == (e, w) for x in near)
        of_e, of_w = len({i for i, x, _ in near if x == e}), sum(w in t.split() for t in texts)
        if both >= 2 and np.log2(both * 60 / (of_w * of_e)) >= 0.3 * np.log2(60 / of_e):
            want.add((e, w, both))
    assert 0 < len(want) < len({x[1:] for x in near}) and {(x["entity"], x["term"], x["n_both"]) for x in told.collect()} == want


def test_mixing(docs, empty):
    assert mixing.targets([10, 10, 100], [3, 1, 2], 180, 2.0) == [20.0, 20.0, 140.0]
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got) and sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(empty).count() == 0


def test_private_data(spark, docs, empty):
    found = private_data.digest(private_data.find_private(docs))
    r = found.filter("doc_id = 10").first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and r["spans"].startswith("email:6:21,ip:22:32,phone:33:50,card:53:72")
    assert found.count() == len(rows()) and private_data.find_private(empty).count() == 0
    told = spark.createDataFrame([(i, "Zorblax writes from z@q.example.org today") for i in range(4)] + [(i, "plain words today") for i in range(4, 60)], "doc_id long, text string")
    spans = private_data.find_private(told)
    assert "term:0:7" in private_data.digest(spans).filter("doc_id = 1").first()["spans"] and private_data.digest(spans).filter("doc_id = 9").first()["spans"] == ""
    assert private_data.sanitise(told).filter("doc_id = 1").first()["text"].startswith("[NAME]")


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    far = "words between the name and the address " * 5
    some = [(1, "Zorblax " + far + "z@q.example.org"), (2, "z@q.example.org " + far + "zorblax"), (3, "z@q.example.org " + far + "Zorblax zorblax"), (4, "Zorblax alone"), (None, "q@r.example.org, Zorblax")]
    told = spark.createDataFrame(some + [(i, "plain words today") for i in range(5, 3000)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term" and s["value"].lower() == "zorblax"] for r in private_data.find_private(told).filter("doc_id < 6 or doc_id is null").collect()}
    assert got == {i: [(m.start(), m.end()) for m in re.finditer("(?i)zorblax", t)] for i, t in some} | {5: []}


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/1", "https://a.example.com/en/x?q#f", "x.net/es/1", "http://b.net/es/1?p", None, "http://x.org/a/?utm_source=f", "http://x.org/a#z", "http://x.org/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("https://X.org/a",), ("https://X.org/a",), (None,)], "url string")
    got = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, listed).orderBy("page_id").collect()]
    assert got == [("www.example.com", "www.example.com/en/", "allow"), ("a.example.com", "example.com/en/", "block"), ("", None, "allow"), ("b.net", "net/es/", "block"), ("", None, "allow"), ("x.org", None, "block"), ("x.org", None, "block"), ("x.org", None, "allow")]
    assert url_filter.url_verdicts(pages.limit(0), listed.limit(0)).count() == 0
    twice = url_filter.url_verdicts(pages.unionByName(pages).withColumns({"block": F.lit(1), "listed": F.lit("x")}), listed)
    assert twice.count() == 2 * len(urls) and twice.filter("verdict = 'block'").count() == 8
    assert [url_filter.blocks_for(n) for n in (0, 10_000, 10**9)] == [1024, 2048, 1 << 18]


def test_media(docs, empty):
    assert [int(media.MU[x]) for x in (0, 127, 128, 255)] == [-32124, 0, 32124, 0] and [int(media.A[x]) for x in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    got = {r["doc_id"]: r for r in media.media_digest(docs).collect()}
    for i, t, *_ in rows():
        raw = (t or "").encode()
        load = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"]) == (len(raw), hashlib.sha256(load).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(load[-32:]) and got[i]["media_sha256"] == hashlib.sha256(media.wav(load)).hexdigest() and got[i]["media_bytes"] == len(media.wav(load))
        samples = [int(media.MU[b]) for b in load]
        level = [sum(int(t[b]) ** 2 for b in load) // len(load) for t in (media.MU, media.A)]
        decoded = media.adpcm_decode(np.frombuffer(load, np.uint8).reshape(-1, 576)).astype(int)
        crossings = sum((a < 0) != (b < 0) for line in decoded.tolist() for a, b in zip(line, line[1:], strict=False))
        assert got[i]["feature"] == f"mu_power={level[0]};a_power={level[1]};adpcm_mean={int(np.abs(decoded).sum()) // (2 * len(load))};adpcm_peak={int(np.abs(decoded).max())};adpcm_crossings={crossings}"
        pad = [samples[0], *samples, samples[-1], samples[-1]]
        half = [max(-32768, min(32767, (9 * (pad[k + 1] + pad[k + 2]) - pad[k] - pad[k + 3] + 8) >> 4)) for k in range(len(samples))]
        assert got[i]["pcm_sha256"] == hashlib.sha256(np.array([x for pair in zip(samples, half, strict=True) for x in pair], "<i2").tobytes()).hexdigest()
    assert media.media_digest(empty).count() == 0
    stored = media.store_pcm(media.store_media(docs.filter("doc_id in (4, 10)"))).collect()
    assert sorted((r["doc_id"], r["codec"], r["rate"]) for r in stored) == [(i, c, 16000) for i in (4, 10) for c in ("a", "adpcm", "mu")]
    for r in stored:
        load = next(t for i, t, *_ in rows() if i == r["doc_id"]).encode()
        load += b"\xff" * (-len(load) % 576)
        assert r["codec"] != "mu" or hashlib.sha256(r["pcm"]).hexdigest() == got[r["doc_id"]]["pcm_sha256"]
        assert np.frombuffer(r["pcm"], "<i2")[::2].tolist() == {"mu": media.MU[list(load)], "a": media.A[list(load)], "adpcm": media.adpcm_decode(np.frombuffer(load, np.uint8).reshape(-1, 576)).ravel()}[r["codec"]].tolist()
    block = np.random.default_rng(0).integers(0, 256, (3, 576), dtype=np.uint8)
    out = media.adpcm_decode(block)
    for b, samples in zip(block, out, strict=True):
        value, at = int.from_bytes(b[:2].tobytes(), "little", signed=True), min(int(b[2]), 88)
        for k, code in enumerate(x for byte in b[4:].tolist() for x in (byte & 15, byte >> 4)):
            assert samples[k] == value
            step = media.STEPS[at]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            at = max(0, min(88, at + media.MOVES[code & 7]))


def test_pieces(docs, empty):
    m = pieces.Pieces(open(pieces.MODEL, "rb").read())
    enc = pieces.encode(docs, chunk=1000)
    got: dict = {}
    for r in enc.orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows():
        if i != 9:
            assert sum((r["ids"] for r in got[i]), []) == m.sp.encode(t or "")
    assert len(got[6]) > 20
    back = {}
    for r in pieces.decode(enc).orderBy("doc_id", "chunk").collect():
        back[r["doc_id"]] = back.get(r["doc_id"], "") + r["text"]
    assert back[6] == LONG and back[10] == rows()[10][1] and pieces.encode(empty).count() == 0
    r = random.Random(2)
    for k in range(40):
        t = "".join(r.choice(list("aabinorst \n中😀") if k % 2 else list("abinor")) for _ in range(300))
        n, size = pieces.normal(t), 70
        at = pieces.chunk_places(len(n), size)
        mats = [pieces.matrix(m, n[max(0, a - m.longest) : a], n[a:b], n[b : b + m.longest]) for a, b in zip(at, at[1:], strict=False)]
        total = mats[0]
        for x in mats[1:]:
            total = pieces.times(total, x)
        assert (total == 0).sum() == 1, "one path alone is the encoding"


def test_token_shards(spark, docs, empty, tmp_path):
    for n in (1, 2, 7, 100, 1000):
        p = token_shards.permuted(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n)) and (token_shards.permuted(p, n, back=True) == np.arange(n)).all()
    fixed = spark.createDataFrame(rows(), DOCS).coalesce(1)
    uri = token_shards.materialise(fixed, str(tmp_path / "out"), length=64, per_shard=16)
    got = token_shards.read_shards(spark, uri).orderBy("slot").collect()
    m = pieces.Pieces(open(pieces.MODEL, "rb").read())
    assert [r["slot"] for r in got] == list(range(len(got))) and sum(len(r["tokens"]) // 2 for r in got) == sum(len(m.sp.encode(t or "")) for _, t, *_ in rows())
    assert token_shards.read_shards(spark, uri, 3, 9).count() == 6
    # One partition, so the places before the permutation are those of a loop over the texts.
    places, order = 0, []
    for i, t, *_ in rows():
        ids = m.sp.encode(t or "")
        order += [(places + j, i, j, ids[64 * j : 64 * j + 64]) for j in range(-(-len(ids) // 64))]
        places += -(-(len((t or "").encode()) + 1) // 64)
    order.sort(key=lambda x: int(token_shards.permuted(np.array([x[0]]), places)[0]))
    assert [(r["doc_id"], r["part"], np.frombuffer(r["tokens"], "<u2").tolist()) for r in got] == [x[1:] for x in order]
    long = b"".join(bytes(r["tokens"]) for r in sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["part"]))
    assert np.frombuffer(long, "<u2").tolist() == m.sp.encode(LONG)
    assert token_shards.shard_digest(empty).count() == 0


def test_classifiers(spark, docs, empty):
    r = random.Random(4)
    plain = lambda: " ".join(r.choice(["tree", "house", "river", "stone", "cloud", "bread"]) for _ in range(40))
    some = [(i, plain() + (" vile" if i % 3 == 0 else "") + (" calm " + "!! " * 20 if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    d, l = spark.createDataFrame(some, DOCS), spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    t = toxicity.toxicity(d, l).join(l, "doc_id").filter("held_out").collect()
    assert len(t) > 40 and np.mean([x["predicted"] == x["toxic"] for x in t]) > 0.95
    q = quality.quality(d, l).join(l, "doc_id").filter("held_out").collect()
    assert len(q) > 40 and np.mean([x["predicted"] == x["quality"] for x in q]) > 0.95
    for f, cols in ((toxicity.toxicity, 5), (quality.quality, 4)):
        got = f(docs, l).collect()
        assert len(got) == len(rows()) and all(0 <= x["score"] <= 1 and len(x) == cols for x in got)
        assert f(empty, l).count() == 0 and f(docs, l.limit(0)).count() == len(rows())
    kept = toxicity.without_flagged(docs, l)
    assert kept.columns == docs.columns and kept.schema["block"].dataType == docs.schema["block"].dataType


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert 6 in ids and not {1, 4} & ids and not {7, 8} <= ids
