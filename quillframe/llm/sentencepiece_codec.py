"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid out in one array of code points and indexed by a suffix array, sorted to the depth
of the longest piece by doubling. All pieces are looked up together by binary search, one character further at a time,
which gives the range of each piece's occurrences; the edges (position, length, piece) are sorted by position and
relaxed: for a unigram model along the best path (Viterbi), for a BPE model by merging, best-scored edge first, two
neighbouring symbols that an edge spans. A BPE model defines its result by merges, so a shortest path over the edges would
differ from the library; the edges are the same.

Words end before a space that follows something else, if no piece goes over such a place (else the whole text is one
word). A batch is indexed in chunks of at most CHUNK code points, so memory is bounded by the longest word.

Only models that leave text as it is (identity normalizer, no removal of extra spaces) are accepted. Characters without
a piece become byte pieces or the unknown id. Special pieces are never found in text.

Defined results: a null text has null ids and decodes to null; an empty text has no ids. Repeated rows and null ids are
rows of their own. An empty table gives an empty result. Other columns are carried; one with the
name of a new column gives way to it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import added, present

SPACE = "▁"
CHUNK = 1 << 19
#: Bytes of words and ids that a worker keeps (and as many from before), what a kept word costs besides, and the longest word that is kept.
CACHE_BYTES, EACH_WORD, KEPT_WORD = 16 << 20, 200, 100
LONG = 40
GAP = 0x110000  # between words; no code point


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces that occur in text, padded to one array of code points, with the options that encoding needs."""

    pieces: list[str]
    ids: list[int]
    scores: list[float]
    bpe: bool
    add_prefix: bool
    unk_id: int = 0
    byte_ids: dict[int, int] = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)  # of every id that decodes to text

    def __post_init__(self) -> None:
        order = sorted(range(len(self.pieces)), key=lambda i: len(self.pieces[i]))
        self.pieces, self.ids, self.scores = ([x[i] for i in order] for x in (self.pieces, self.ids, self.scores))
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.depth = int(self.lengths.max(initial=1))
        self.codes = np.full((len(self.pieces), self.depth), GAP, dtype=np.int64)
        for i, p in enumerate(self.pieces):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        self.id_of, self.score_of = np.array(self.ids, dtype=np.int64), np.array(self.scores)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = dict(x for x in _fields(sp.serialized_model_proto()) if x[0] in (2, 3))
        trainer, normalizer = (dict(_fields(parts.get(k, b""))) for k in (2, 3))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models with the identity normalizer, extra spaces kept, are supported")
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        return cls(pieces, plain, [sp.get_score(i) for i in plain], trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)), sp.unk_id(), bytes_, dict(zip(plain, pieces)))


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """x[i + k], 0 beyond the end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), dtype=x.dtype)])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` characters (or more) that begin there, by prefix doubling.

    The first keys hold as many characters as the batch's alphabet lets into 62 bits.
    """
    there = np.zeros(GAP + 1, dtype=np.int64)
    there[text] = 1
    code = np.cumsum(there)[text]
    bits = int(code.max(initial=1)).bit_length()
    width, key = 62 // bits, np.zeros(len(text), dtype=np.int64)
    for i in range(width):
        key = key << bits | _ahead(code, i)
    while True:
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        if width >= depth or new.all():
            return order
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (len(text) + 2) + _ahead(rank, width)
        width *= 2


def occurrences(text: np.ndarray, order: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range [low, high) of the suffix array that begins with it; all pieces a character further per round."""
    n = len(text)
    padded = np.concatenate([text, np.full(vocabulary.depth, -1, dtype=text.dtype)])
    low, high = np.zeros(len(vocabulary.pieces), dtype=np.int64), np.full(len(vocabulary.pieces), n, dtype=np.int64)
    first = np.searchsorted(vocabulary.lengths, np.arange(vocabulary.depth), side="right")  # pieces longer than the depth are last
    for d in range(vocabulary.depth):
        live = np.arange(first[d], len(low))
        live = live[low[live] < high[live]]
        want = vocabulary.codes[live, d]
        for right in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                there = padded[order[mid] + d]
                less = there <= want[open_] if right else there < want[open_]
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
            if right:
                high[live] = a
            else:
                start = a
        low[live] = start
    return low, high


def edges(text: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position * (depth + 1) + length, piece), sorted by position and length."""
    order = suffix_array(text, vocabulary.depth)
    low, high = occurrences(text, order, vocabulary)
    counts = high - low
    piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    key = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    key += np.arange(len(key))
    key = order[key] * (vocabulary.depth + 1) + vocabulary.lengths[piece]
    by = np.argsort(key)  # no two edges are equal
    return key[by], piece[by]


class _Chunk:
    """Words laid out with gaps, their edges, and the relaxation of each word."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.v, self.words = vocabulary, words
        gap = chr(0xFFFF)
        codes = np.frombuffer(gap.join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64)
        if len(words) > 1:
            codes = codes.copy()
            codes[self.starts[1:] - 1] = GAP
        self.key, self.piece = edges(codes, vocabulary)

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece at each span, -1 if there is none."""
        if not len(self.key):
            return np.full(len(start), -1)
        want = start * (self.v.depth + 1) + np.minimum(length, self.v.depth)
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((self.key[at] == want) & (length <= self.v.depth), self.piece[at], -1)

    def merged(self, which: np.ndarray) -> list[np.ndarray]:
        """Symbol starts of the words in `which`: every round merges the best pair, leftmost of equals, of every word."""
        out: list[np.ndarray] = []
        sizes = self.sizes[which]
        word = np.repeat(np.arange(len(which)), sizes)
        start = np.repeat(self.starts[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        length = np.ones(len(start), dtype=np.int64)
        score = np.full(len(start), -np.inf)  # of the merge with the next symbol
        fresh = np.arange(len(start))
        while len(start):
            pair = fresh[fresh + 1 < len(start)]
            pair = pair[word[pair] == word[pair + 1]]
            score[fresh] = -np.inf
            found = self.find(start[pair], length[pair] + length[pair + 1])
            score[pair] = np.where(found >= 0, self.v.score_of[found], -np.inf)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.maximum.reduceat(score, first)
            done = ~np.isfinite(best)
            span = np.diff(np.concatenate([first, [len(start)]]))
            keep = np.repeat(~done, span)
            out.append(start[~keep])
            if done.all():
                break
            hit = np.flatnonzero(keep & (score == np.repeat(best, span)))
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            length[hit] += length[hit + 1]
            keep[hit + 1] = False
            touched = np.zeros(len(start), dtype=bool)
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            start, length, word, score = start[keep], length[keep], word[keep], score[keep]
            fresh = np.flatnonzero(touched[keep])
        return out

    def merged_long(self, w: int) -> np.ndarray:
        """The same for one long word, with a heap."""
        base, n, v = int(self.starts[w]), int(self.sizes[w]), self.v
        lo, hi = np.searchsorted(self.key, [base * (v.depth + 1), (base + n) * (v.depth + 1)])
        scores = dict(zip(self.key[lo:hi].tolist(), v.score_of[self.piece[lo:hi]].tolist()))
        size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else n
            if j < n and size[i] + size[j] <= v.depth:
                s = scores.get((base + i) * (v.depth + 1) + size[i] + size[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], right[i] = a + b, 0, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return base + np.flatnonzero(np.array(size))

    def best_path(self, w: int) -> np.ndarray:
        """Viterbi over the edges of one word; a character without a piece costs the least score less 10."""
        base, n, v = int(self.starts[w]), int(self.sizes[w]), self.v
        floor = float(v.score_of.min(initial=0.0)) - 10
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, dtype=np.int64)
        best[0] = 0.0
        for i in range(n):
            lo, hi = np.searchsorted(self.key, [(base + i) * (v.depth + 1), (base + i + 1) * (v.depth + 1)])
            ends = i + self.key[lo:hi] % (v.depth + 1)
            gain = best[i] + v.score_of[self.piece[lo:hi]]
            if not (ends == i + 1).any():
                ends, gain = np.append(ends, i + 1), np.append(gain, best[i] + floor)
            better = gain > best[ends]
            best[ends[better]], back[ends[better]] = gain[better], i
        starts, at = [], n
        while at > 0:
            at = int(back[at])
            starts.append(at)
        return base + np.array(starts[::-1], dtype=np.int64)

    def ids(self) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        if self.v.bpe:
            long = self.sizes > LONG
            found = self.merged(np.flatnonzero(~long)) + [self.merged_long(int(w)) for w in np.flatnonzero(long)]
        else:
            found = [self.best_path(w) for w in range(len(self.words))]
        starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, np.append(self.starts, np.iinfo(np.int64).max))
        word = np.repeat(np.arange(len(self.words)), np.diff(bounds))
        ends = np.minimum(np.append(starts[1:], np.iinfo(np.int64).max), (self.starts + self.sizes)[word])
        piece = self.find(starts, ends - starts)
        ids = self.v.id_of[piece].astype("<i4")
        raw, at = ids.tobytes(), (bounds * 4).tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:])]
        for w in np.unique(word[piece < 0]).tolist():
            lo, hi = bounds[w], bounds[w + 1]
            chars = [self.words[w][int(x) - int(self.starts[w])] for x in starts[lo:hi]]
            out[w] = np.array([y for x, i, c in zip(piece[lo:hi], ids[lo:hi], chars) for y in ([i] if x >= 0 else self.unknown(c))], dtype="<i4").tobytes()
        return out

    def unknown(self, char: str) -> list[int]:
        return [self.v.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unk_id]


class Codec:
    """Encodes batches of texts and decodes ids. Keeps the ids of short words it has met lately, within CACHE_BYTES, and as many of those before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known, self.older, self.held = vocabulary, {}, {}, 0
        self.bytes_of = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in vocabulary.names.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in vocabulary.byte_ids.items()} | {vocabulary.unk_id: " ⁇ ".encode()}
        spans = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=0) + 1)] + [b""]  # the last: ids that mean no text
        self.table = np.frombuffer(b"".join(spans), dtype=np.uint8)
        self.size_of = np.array([len(x) for x in spans], dtype=np.int64)
        self.place_of = np.cumsum(self.size_of) - self.size_of
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.v.add_prefix else "") + text.replace(" ", SPACE)
        return self.cut(text) if self.v.splits else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        split = [self.words(t) for t in texts]
        need = set().union(*split)
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        missing = need.difference(self.known)
        again = missing.intersection(self.older)
        self.known |= {w: self.older[w] for w in again}
        self.held += sum(EACH_WORD + len(w) + len(self.older[w]) for w in again)
        new, at = list(missing - again), 0
        while at < len(new):
            chunk, size = [], 0
            while at < len(new) and (not chunk or size + len(new[at]) < CHUNK):
                chunk.append(new[at])
                size += len(new[at]) + 1
                at += 1
            self.known |= zip(chunk, _Chunk(chunk, self.v).ids())
        of = self.known.__getitem__
        out = [b"".join(map(of, ws)) for ws in split]
        for w in new:
            if len(w) > KEPT_WORD:  # in scripts without spaces a word is a whole text
                del self.known[w]
            else:
                self.held += EACH_WORD + len(w) + len(self.known[w])
        return out

    def decode(self, texts: list[bytes]) -> list[str]:
        """Texts of ids: the bytes of all pieces are gathered at once."""
        ids = np.frombuffer(b"".join(texts), dtype="<i4")
        ids = np.where((ids >= 0) & (ids < len(self.size_of)), ids, len(self.size_of) - 1)
        sizes = self.size_of[ids]
        ends = np.cumsum(sizes)
        raw = self.table[np.arange(int(sizes.sum())) + np.repeat(self.place_of[ids] - ends + sizes, sizes)].tobytes()
        last = np.cumsum([len(t) // 4 for t in texts])
        cuts = np.concatenate([[0], np.concatenate([[0], ends])[last]]).astype(np.int64).tolist() if texts else [0]
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if self.v.add_prefix and t.startswith(" ") else t for t in out]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Vocabulary.read(path))


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    path = model or default_model()

    def run(texts: list) -> list:
        return [[None if x is None else np.frombuffer(x, dtype="<i4") for x in present(texts, codec(path).encode)]]

    return added(docs, [text_col], [(ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], run)


def decode(docs: DataFrame, model: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    path = model or default_model()

    def run(rows: list) -> list:
        return [present([None if x is None else np.array(x, dtype="<i4").tobytes() for x in rows], codec(path).decode)]

    return added(docs, [ids_col], [(text_col, T.StringType(), pa.string())], run)


def report(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip (decoded is the text).

    Encodes and decodes in one worker. A marker of a space (U+2581) in the text itself comes back as a space.
    """
    path = model or default_model()

    def run(texts: list) -> list:
        ids = present(texts, codec(path).encode)
        back = present(ids, codec(path).decode)
        return [
            [None if x is None else len(x) // 4 for x in ids],
            [None if x is None else zlib.crc32(x) for x in ids],
            [None if x is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back],
            [None if t is None else x == t.replace(SPACE, " ") for x, t in zip(back, texts)],
        ]

    columns = [("n_ids", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("decoded_sha256", T.StringType(), pa.string()), ("round_trip", T.BooleanType(), pa.bool_())]
    return added(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["text"], columns, run).drop("text")
