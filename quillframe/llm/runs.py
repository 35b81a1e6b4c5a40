"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that cannot be extended. The texts
of a batch become one array of word numbers. For each period p the places 0, p, 2p, ... of a text are the grid: a run of
four periods covers four grid places with equal words, so that only such places (`_grid`) are candidates. Their texts get
names: at level k two places have the same name if the 2**k words from there on are equal; the names of a level are the
ranks of pairs of names of the level below. The longest common extension of two places is found by going down the levels,
all candidates at once; to the left the same names serve, read from the end. No hashes and no suffix sorting are involved.

A candidate counts only at the first grid place of its stretch, where it is extended both ways; stretches found under
several periods keep the smallest, which is their period.

Defined results: a null text has no words; a document without a run has nulls for the longest and the hash of no bytes; a
null id is kept, and `edited` leaves its words alone. Repeated rows are rows of their own, an empty table gives an empty
result, extra columns are not read. Texts are taken whole: memory is bounded by the longest text (some 8 bytes a word and level).
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import added

#: Candidates that are looked at together.
BLOCK = 1 << 21


class Names:
    """Level k has, for each place, the name of the 2**k words from there on."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [words.astype(np.int32)]
        while 2 << len(self.levels) - 1 <= longest:
            below, step = self.levels[-1].astype(np.int64), 1 << len(self.levels) - 1
            pair = below[:-step] * (int(below.max()) + 1) + below[step:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def extended(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and from j > i on are equal, up to the bound; or before them, down to it.

        Fewer than twice the top level's words are, so each level is passed once.
        """
        i, j, start = i.copy(), j.copy(), j
        for k in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << k, self.levels[k]
            at = np.nonzero(i - size >= bound if back else j + size <= bound)[0]
            off = size if back else 0
            at = at[names[i[at] - off] == names[j[at] - off]]
            i[at] += -size if back else size
            j[at] += -size if back else size
        return np.abs(j - start)


def _grid(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, period) of the grid places where four words, a period apart, are equal."""
    texts = np.nonzero(size >= 6)[0]
    periods = size[texts] // 4
    text = np.repeat(texts, periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (size[text] - 3 * period - 1) // period + 1  # grid places with three more after them
    ends = np.cumsum(places)
    found = []
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
        at = np.arange(lo, min(lo + BLOCK, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        p = period[pair]
        place = first[text[pair]] + (at - ends[pair] + places[pair]) * p
        keep = words[place] == words[place + p]
        place, p, pair = place[keep], p[keep], pair[keep]
        keep = (words[place] == words[place + 2 * p]) & (words[place] == words[place + 3 * p])
        found.append((text[pair[keep]], place[keep], p[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def find(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts that lie one after the other in `words`: (text, start in the text, length, period), by text, start and period."""
    first = np.cumsum(size) - size
    text, place, period = _grid(words, first, size)
    if len(text):
        some = np.unique(text)  # names are made of the texts with candidates alone
        moved = np.zeros(len(size), np.int64)
        moved[some] = np.cumsum(size[some]) - size[some] - first[some]
        names = Names(np.concatenate([words[first[t] : first[t] + size[t]] for t in some]), int(size[some].max()))
        begin = (first + moved)[text]
        place, end = place + moved[text], begin + size[text]
        before = names.extended(place, place + period, np.maximum(begin, place - period), back=True)
        keep = before < period  # else the grid place before this one is in the stretch
        text, place, period, before, begin, end = (x[keep] for x in (text, place, period, before, begin, end))
        start, length = place - before - begin, before + period + names.extended(place, place + period, end)
        keep = length >= np.maximum(6, 4 * period)
        text, start, length, period = (x[keep] for x in (text, start, length, period))
    else:
        start = length = text
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    same = np.zeros(len(text), bool)
    same[1:] = (text[1:] == text[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    text, start, length, period = (x[~same] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def edited(doc_id: int | None, words: list) -> list:
    """Makes the rest of one document in ten periodic, by its id: a test bed for the runs."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _described(texts: list[list[bytes]]) -> list[list]:
    """The report's columns of tokenized texts."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(texts)), dtype=np.int32, count=int(size.sum()))
    text, start, length, period = find(words, size)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    rows = []
    for t, lo, hi in zip(texts, cuts, cuts[1:]):
        if lo == hi:
            rows.append((0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(t)).hexdigest()))
            continue
        s, n, q = start[lo:hi], length[lo:hi], period[lo:hi]
        best = np.lexsort((q, s, -n))[0]
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        change = np.zeros(len(t) + 1, np.int64)
        np.add.at(change, s + q, 1)
        np.add.at(change, s + n, -1)
        kept = [t[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()]
        top = (int(s[best]), int(n[best]), int(q[best]), int(1000 * n[best] // q[best]))
        rows.append((hi - lo, *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]


_NUMBER, _TEXT = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
_COLUMNS = [*((n, *_NUMBER) for n in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", *_TEXT), ("collapsed_sha256", *_TEXT)]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256; with `edit`, of the edited words."""
    def run(texts: list, ids: list) -> list:
        words = [t.encode().split() for t in texts]  # of bytes, split() cuts at \x20 and \x09-\x0D
        return _described([edited(i, w) for i, w in zip(ids, words)] if edit else words)

    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return added(bare, ["text", "doc_id"], _COLUMNS, run).drop("text")


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each run of words cut to its first period; words are joined by one space. Texts without a run, and null ones, stay as they are."""
    def run(texts: list) -> list:
        words = [(t or "").encode().split() for t in texts]
        number: dict[bytes, int] = {}
        size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), dtype=np.int32, count=int(size.sum()))
        text, start, length, period = find(flat, size)
        first = (np.cumsum(size) - size)[text]
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, first + start + period, 1)
        np.add.at(change, first + start + length, -1)
        gone, out, cut = np.cumsum(change) > 0, list(texts), np.concatenate([[0], np.cumsum(size)])
        for t in np.unique(text).tolist():
            out[t] = b" ".join(w for w, g in zip(words[t], gone[cut[t] : cut[t + 1]].tolist()) if not g).decode()
        return [out]

    made = added(docs, [text_col], [(text_col, T.StringType(), pa.string())], run)
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
