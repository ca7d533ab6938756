"""Ids by byte pairs against those of the SentencePiece library; op2 hands ordinary texts to the former."""

import random

import numpy as np
import pandas as pd
import pytest

from readqc_spark.llm import byte_pairs, pieces, token_shards


@pytest.fixture(scope="module")
def m():
    return pieces.Pieces(open(pieces.MODEL, "rb").read())


@pytest.mark.parametrize("all_merged", [True, False])
def test_same_ids_as_the_library(m, monkeypatch, all_merged):
    pairs = byte_pairs.BytePairs(m)
    assert pairs.merger is not None
    if all_merged:  # no text goes to the library whole, and texts have several slabs
        for name, value in (("SLAB", 300), ("SHORT", 0), ("PER_ODD", 1)):
            monkeypatch.setattr(byte_pairs, name, value)
    r = random.Random(7)
    known = sorted({c for p in m.ids for c in p})
    strange = [chr(ord(c) + 1) for c in known]  # they share their first bytes with characters of the model
    some = ["", " ", "  ", "a ", " a", "\u2581", "a\u2581 b", "a" * 256, "b " + "ab" * 500 + " c", "\n\n a\t", "\U0010ffff\uffff\ud7ff"]
    for letters in (list("ab the\u2581 \n"), list(" \u2581"), list("aeinorst  "), list("<s></s>unk0x41 "), [*known, *" " * 400], [*known, *strange, *" " * 900], list("a\u00e9\u4e2d\U0001f600 \t\u3000\0e\u0301")):
        some += ["".join(r.choices(letters, k=r.choice([3, 10, 40, 700]))) for _ in range(300)]
    some += ["".join(r.choices(list(m.ids), k=20)).replace("\u2581", " ") for _ in range(2000)]
    for text, got, ids in zip(some, pairs.encode(some), m.sp.encode(some), strict=True):
        assert got.tolist() == ids, text
    assert pairs.encode([]) == []


@pytest.mark.parametrize("tied", [False, True])
def test_models_that_do_not_allow_for_it_and_no_tiktoken(m, monkeypatch, tied):
    if tied:
        monkeypatch.setattr(m, "score", dict.fromkeys(m.score, 0.0))
    else:
        monkeypatch.setattr(byte_pairs, "tiktoken", None)
    pairs = byte_pairs.BytePairs(m)
    some = ["one  two three", "", "four five six " * 30]
    assert pairs.merger is None and [x.tolist() for x in pairs.encode(some)] == m.sp.encode(some)


def test_odd_texts_go_to_the_library_whole(m):
    pairs = byte_pairs.BytePairs(m)
    assert all(pairs._merged(t) is None for t in ("", "one two", "one  two " * 100, "a" * 300))
    assert all(pairs._merged(t).tolist() == m.sp.encode(t) for t in ("one two " * 100 + " three " + "four " * 100, "b " * 300 + "a" * 300 + " c" * 300))


def test_op2_hands_no_ordinary_text_to_the_library(m, monkeypatch):
    some = ["It is one of several ordinary texts, " * 4 + "as they are", "with \u00fcml\u00e4uts and a line\nmore, " * 4 + "as here"] * 30
    seen = set()

    class Spy:
        def encode(self, x, **kw):
            seen.update([x] if isinstance(x, str) else x)
            return m.sp.encode(x, **kw)

        def __getattr__(self, name):
            return getattr(m.sp, name)

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    class Begin:
        value = {0: (0, sum(token_shards._room(len(t.encode()), 4) for t in some))}

    spied = pieces.Pieces(open(pieces.MODEL, "rb").read())
    spied.sp = Spy()
    monkeypatch.setattr(token_shards, "TaskContext", Task)
    monkeypatch.setattr(token_shards, "loaded", lambda model: spied)
    frames = [pd.DataFrame({"doc_id": range(len(some)), "text": some})]
    got = pd.concat(token_shards._cut_up(iter(frames), None, 4, Begin.value[0][1], Begin, 16, 1))
    for k, text in enumerate(some):
        parts = got[got["doc_id"] == k].sort_values("part")["tokens"]
        assert np.frombuffer(b"".join(parts), "<u2").tolist() == m.sp.encode(text)
    assert seen.isdisjoint(some), "ordinary texts were encoded by the slower library"
