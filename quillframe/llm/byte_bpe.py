"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

A file of ranks (base64 of a token's bytes, its rank) becomes a byte-level model of the tokenizers library: each byte has a
printable stand-in, a token is the string of its bytes' stand-ins, and each way to split a token into two tokens is a
merge with the token's rank. The texts of a batch are cut into the matches of the pattern, each of which is encoded by
itself; the library sees each distinct match once and a worker keeps what it has seen, within CACHE_BYTES.

Offsets come from a map of bytes to characters: a running count of the bytes that begin one. A token that begins or ends
inside a character covers the whole of it, so the spans of neighbours may share a character. Decoding reverses the byte
table, gathers the bytes of all tokens of a batch at once and only then reads them as UTF-8, so that characters split over
tokens come back whole; `token_texts` gives such a character to the token with its last byte. Bytes that are no UTF-8, as
after a cut list of ids, become U+FFFD in texts and stay as they are in bytes.

Defined results: in `encode` and `decode` a null text has null ids and null ids have a null text, an empty text has no ids
and no ids are an empty text; `report` takes null as empty. Unknown ids raise. Repeated rows and null document ids are rows
of their own, an empty table gives an empty result, other columns are carried; one with the name of a new column gives
way to it. Texts are taken whole; memory is bounded by the longest text and its ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import added, present
from .tokens import byte_alphabet

#: Bytes of matches and ids that a worker keeps (and as many from before), what a kept match costs besides, and the longest that is kept.
CACHE_BYTES, EACH_PIECE, KEPT_PIECE = 24 << 20, 200, 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _unassigned() -> np.ndarray:
    """Whether a code point is unassigned."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), dtype=bool, count=0x110000)


class Codec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        stand_in = {byte: char for char, byte in byte_alphabet().items()}
        spelt = {token: "".join(map(stand_in.__getitem__, token)) for token in ranks}
        merges = [(spelt[token[:i]], spelt[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={spelt[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain, self.rare = regex.compile(pattern).findall, _unassigned()
        self.sure = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.known, self.older, self.held = {}, {}, 0
        bare = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bare[rank] = token
        self.table = np.frombuffer(b"".join(bare), dtype=np.uint8)
        self.size_of = np.array([len(t) for t in bare], dtype=np.int64)
        self.place_of = np.cumsum(self.size_of) - self.size_of

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern. The regex package knows later versions of Unicode than the two libraries, so texts with
        code points that this Python has as unassigned are cut by the slower one, whose classes are tiktoken's."""
        if not text.isascii() and self.rare[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any():
            return [piece for piece, _ in self.sure(text)]
        return self.plain(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        split = [self.cut(t) for t in texts]
        need = set().union(*split)
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        missing = need.difference(self.known)
        again = missing.intersection(self.older)
        self.known |= {p: self.older[p] for p in again}
        new = list(missing - again)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            self.known |= zip(part, (np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(part, add_special_tokens=False)))
        of = self.known.__getitem__
        out = [b"".join(map(of, pieces)) for pieces in split]
        for p in new:
            if len(p) > KEPT_PIECE:
                del self.known[p]
        self.held += sum(EACH_PIECE + len(p) + len(self.known[p]) for p in missing if len(p) <= KEPT_PIECE)
        return out

    def sizes(self, ids: bytes) -> np.ndarray:
        """Bytes of each token."""
        return self.size_of[np.frombuffer(ids, dtype="<u4")]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes that each row's ids stand for: those of all tokens are gathered at once."""
        ids = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int64)
        if len(ids) and (ids.max() >= len(self.size_of) or not self.size_of[ids].all()):
            raise ValueError("an id without a token")
        sizes = self.size_of[ids]
        ends = np.cumsum(sizes)
        raw = self.table[np.arange(int(sizes.sum())) + np.repeat(self.place_of[ids] - ends + sizes, sizes)].tobytes()
        last = np.cumsum([0, *(len(r) // 4 for r in rows)])
        cuts = np.concatenate([[0], ends]).astype(np.int64)[last].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def spans(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last, from the text's UTF-8 and the bytes of each token."""
    begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    char_of = np.cumsum(begins) - 1
    ends = np.cumsum(sizes)
    return char_of[ends - sizes], char_of[ends - 1] + 1


def token_texts(raw: bytes, sizes: np.ndarray) -> list[str]:
    """The text of each token; a character split over tokens belongs to the one with its last byte, the others before it are shorter."""
    begins = np.append((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, True)
    whole = np.concatenate([[0], np.cumsum(begins[1:])])  # characters that end within so many bytes
    cuts = np.concatenate([[0], whole[np.cumsum(sizes)]]).astype(np.int64).tolist()
    text = raw.decode("utf-8")
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


_IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids", offsets: bool = True) -> DataFrame:
    """docs with `ids` and, on demand, `starts` and `ends`: the characters that each token covers."""
    path, cut = ranks or default_ranks(), pattern or default_pattern()

    def run(texts: list) -> list:
        c = codec(path, cut)
        found = present(texts, c.encode)
        ids = [None if x is None else np.frombuffer(x, dtype="<i4") for x in found]
        if not offsets:
            return [ids]
        at = [None if x is None else spans(t.encode(), c.sizes(x)) for t, x in zip(texts, found)]
        return [ids, [a and a[0].astype("<i4") for a in at], [a and a[1].astype("<i4") for a in at]]

    columns = [(n, _IDS, pa.list_(pa.int32())) for n in (ids_col, "starts", "ends")]
    return added(docs, [text_col], columns if offsets else columns[:1], run)


def decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, ids_col: str = "ids", text_col: str = "decoded", pieces: bool = False) -> DataFrame:
    """docs with the text of their ids, or with the texts of the single tokens (`pieces`; ids must then be those of a whole text)."""
    path, cut = ranks or default_ranks(), pattern or default_pattern()

    def run(rows: list) -> list:
        c = codec(path, cut)
        ids = [None if x is None else np.array(x, dtype="<u4").tobytes() for x in rows]
        raw = present(ids, c.decode)
        if pieces:
            return [[None if r is None else token_texts(r, c.sizes(i)) for r, i in zip(raw, ids)]]
        return [[None if r is None else r.decode("utf-8", "replace") for r in raw]]

    kind = (T.ArrayType(T.StringType()), pa.list_(pa.string())) if pieces else (T.StringType(), pa.string())
    return added(docs, [ids_col], [(text_col, *kind)], run)


def report(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, split_tokens (tokens that end inside a character), round_trip (decoded is the text)."""
    path, cut = ranks or default_ranks(), pattern or default_pattern()

    def run(texts: list) -> list:
        c = codec(path, cut)
        ids = present(texts, c.encode)
        back = c.decode(ids)
        raw = [t.encode() for t in texts]
        return [
            [len(x) // 4 for x in ids],
            [hashlib.sha256(x).hexdigest() for x in ids],
            [hashlib.sha256(b).hexdigest() for b in back],
            [_split(r, c.sizes(x)) for r, x in zip(raw, ids)],
            [r == b for r, b in zip(raw, back)],
        ]

    columns = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    columns += [("split_tokens", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return added(bare, ["text"], columns, run).drop("text")


def _split(raw: bytes, sizes: np.ndarray) -> int:
    if raw.isascii() or not len(sizes):
        return 0
    starts, ends = spans(raw, sizes)
    return int((starts[1:] < ends[:-1]).sum())
