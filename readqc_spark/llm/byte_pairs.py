"""The ids that a BPE SentencePiece model gives for whole texts, by the byte-pair merger of tiktoken, at less than half the library's time.

Both mergers join the neighbours whose joint piece has the best score, the leftmost of equals. No piece goes from a word into the next, so
a text's ids are those of its words, each with the space before it. What differs is settled here:

1. tiktoken begins with bytes, the library with characters. The bytes of all characters that occur in pieces are therefore joined first,
   by ranks before those of all pieces; what is left of other characters stands for its bytes, as in the library.
2. tiktoken takes a word that is a piece as it is. Each such piece is held against the library when a model is loaded.
3. Among equal scores tiktoken goes by rank, not by place. Only pieces with several spaces may have equal scores.

Words after several spaces, and words of more than LONG characters, for which tiktoken's time may grow with their square, go to the library.
Where that would cost more than it spares, in texts with more than one such word for PER_ODD characters and in texts below SHORT, the library
encodes the whole text; so it does with every text if a model doesn't allow for 2 or 3, or where tiktoken isn't installed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

from readqc_spark.llm.pieces import SPACE, Pieces

try:
    import tiktoken
except ImportError:
    tiktoken = None

LONG, SLAB, PER_ODD, SHORT = 256, 1 << 20, 400, 100
_ODD = re.compile(f" {{2,}}[^ ]*| [^ ]{{{LONG + 1},}}")


class BytePairs:
    def __init__(self, m: Pieces):
        self.sp = m.sp
        many = [p for p in m.ids if len(p) > 1 and SPACE * 2 not in p]
        words = [p for p in many if p[0] == SPACE]
        same = m.sp.encode([p[1:] for p in words], num_threads=1) == [[m.ids[p]] for p in words]
        self.merger = None
        if tiktoken is None or not same or len({m.score[p] for p in many}) < len(many):
            return
        # What each token of tiktoken's stands for, in the order of their ranks.
        ids: dict[bytes, list[int]] = {bytes([b]): m.to_ids([chr(b)]) if b < 128 else [m.byte[b]] for b in range(256)}
        ids[b" "] = m.to_ids([SPACE])
        for c in sorted({c for p in m.ids for c in p} - {SPACE}):
            code = c.encode()
            for n in range(2, len(code)):
                ids.setdefault(code[:n], [m.byte[b] for b in code[:n]])
            ids[code] = m.to_ids([c])
        for p in sorted(many, key=m.score.get, reverse=True):
            ids[p.replace(SPACE, " ").encode()] = [m.ids[p]]
        self.merger = tiktoken.Encoding("pieces", pat_str=" [^ ]*", mergeable_ranks={b: k for k, b in enumerate(ids)}, special_tokens={})
        count = np.array([len(x) for x in ids.values()])
        self.used = np.arange(count.max()) < count[:, None]
        self.ids = np.zeros(self.used.shape, "<u2")
        self.ids[self.used] = np.concatenate(list(ids.values()))
        self.first, self.single = self.ids[:, 0].copy(), count == 1

    def _plain(self, text: str) -> Iterator[np.ndarray]:
        """Ids of words with one space before each, slab by slab."""
        at = 0
        while at < len(text):
            end = text.rfind(" ", at + 1, at + SLAB) if len(text) - at > SLAB else len(text)
            got = np.asarray(self.merger.encode_ordinary(text[at:end]), np.int32)
            yield self.first[got] if self.single[got].all() else self.ids[got][self.used[got]]
            at = end

    def _merged(self, text: str) -> np.ndarray | None:
        """Ids of a text; None if the library is to encode it whole."""
        if self.merger is None or len(text) < max(SHORT, 1):
            return None
        text, at, out = " " + text.replace(SPACE, " "), 0, []
        most = len(text) // PER_ODD
        odd = [x.span() for x in islice(_ODD.finditer(text), most + 1)]
        if len(odd) > most:
            return None
        for a, b in odd:
            out += [*self._plain(text[at:a]), np.asarray(self.sp.encode(text[a + 1 : b]), "<u2")]
            at = b
        out += self._plain(text[at:])
        return out[0] if len(out) == 1 else np.concatenate(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian uint16; the model has 65,536 at most."""
        out = [self._merged(t) for t in texts]
        whole = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(whole, self.sp.encode([texts[k] for k in whole], num_threads=1), strict=True):
            out[k] = np.asarray(ids, "<u2")
        return out


@lru_cache(1)
def byte_pairs(m: Pieces) -> BytePairs:
    """The byte pairs of a model, made once in each worker."""
    return BytePairs(m)
