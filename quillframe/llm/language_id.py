"""Language identification by n-gram filters with language bit masks.

Learning counts character n-grams of all labelled texts, exactly and distributed: every Arrow batch folds its own, Spark
adds them up. An n-gram belongs to a language if it makes up at least `least_share` of the n-grams of that language's
texts. The filter is a bit-sliced Bloom filter: `slots` positions, each with a mask that has one bit per language; an
n-gram sets its language bits at `hashes` positions, so that the AND of those masks returns all languages that hold the
n-gram. It is built by OR-ing masks per position and has a size fixed by its parameters, whatever the corpus.

A prediction adds up, per language, the n-grams whose mask has its bit, corrects the count for the share of positions
that would answer yes by chance, and takes the largest; ties go to the language that sorts first. The score is the
corrected share of the text's n-grams, from 0 to 1.

Text is lower-cased; every run of characters that aren't letters is one space. Long texts go through in pieces.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if nothing was learned.
Rows with a null label or text are not learned from. Repeated rows count as often as they occur. An empty table gives
an empty result. Extra columns are carried by `keep_known` and not read otherwise.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, Scratch, ship

N = 3
PIECE = 1 << 20
SPACE = 32


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Packed n-grams (21 bits a character) of a text, in pieces that overlap by n - 1 characters."""
    tail = np.array([SPACE], dtype=np.uint64)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        last = at + PIECE >= len(text)
        codes = np.concatenate([tail, np.where(_letters()[codes], codes, SPACE), *([np.array([SPACE], dtype=np.uint64)] if last else [])])
        codes = codes[~((codes == SPACE) & (np.concatenate([[0], codes[:-1]]) == SPACE))]
        if len(codes) >= N:
            out = np.zeros(len(codes) - N + 1, dtype=np.uint64)
            for i in range(N):
                out = (out << np.uint64(21)) | codes[i : len(codes) - N + 1 + i]
            yield out[(out >> np.uint64(21)) & np.uint64((1 << 21) - 1) != SPACE]  # a space in the middle says little
        tail = codes[-(N - 1) :]


def positions(grams: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """hashes x n positions below slots, from one 64-bit mix (the finalizer of SplitMix64)."""
    x = grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    one, two = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) % np.uint64(slots) for i in range(hashes)]).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """langs[i] has bit i of each mask; masks: one uint64 per position; chance[i]: how often bit i answers yes by chance."""

    langs: tuple[str, ...]
    masks: np.ndarray
    hashes: int
    chance: np.ndarray

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        counts, total = np.zeros(len(self.langs)), 0
        for grams in ngrams(text):
            at = positions(grams, len(self.masks), self.hashes)
            mask = self.masks[at[0]]
            for row in at[1:]:
                mask = mask & self.masks[row]
            for i in range(len(self.langs)):
                counts[i] += np.count_nonzero(mask & np.uint64(1 << i))
            total += len(grams)
        return counts, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        counts, total = self.hits(text)
        share = np.clip((counts / max(total, 1) - self.chance) / (1 - self.chance), 0, 1)
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            parts = by_lang.setdefault(lang, [])
            parts += ngrams(text.as_py())
            if sum(map(len, parts)) > 1 << 22:
                yield _folded(lang, parts)
                parts.clear()
        for lang, parts in by_lang.items():
            yield _folded(lang, parts)
    give_back()


def _folded(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
    grams, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", slots: int = 1 << 17, hashes: int = 3, least_share: float = 1e-5) -> Filter:
    """The filter of all labelled rows. Up to 64 languages (bits of a mask)."""
    ship(labelled.sparkSession)
    base = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = base.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tmp = Scratch(labelled.sparkSession, "language-id")
    counts = tmp.keep(counts, "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r.lang: r.total for r in totals.limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    langs = tuple(sorted(sizes))
    bit = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, (1 << i) - (1 << 64 if i == 63 else 0))]) if langs else None
    masks = np.zeros(slots, dtype=np.uint64)
    if langs:
        frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * least_share)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = positions(b.column(0).to_numpy().astype(np.uint64), slots, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1)), pa.array(np.tile(b.column(1).to_numpy(), hashes))], ["slot", "bit"])

        placed = frequent.select("gram", F.element_at(bit, F.col("lang")).cast("long").alias("bit")).mapInArrow(place, "slot bigint, bit bigint")
        for r in placed.groupBy("slot").agg(F.bit_or("bit").alias("mask")).toLocalIterator():  # at most `slots` rows
            masks[r.slot] = np.uint64(r["mask"] & (1 << 64) - 1)
    tmp.drop()
    chance = np.array([(np.count_nonzero(masks & np.uint64(1 << i)) / slots) ** hashes for i in range(len(langs))])
    return Filter(langs, masks, hashes, chance)


def predict(docs: DataFrame, model: Filter, text_col: str = "text", carry: list | None = None) -> DataFrame:
    """carry columns, then lang_pred and score. Only the text is looked at."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the filter's parameters
    kept = docs.select(*(carry or []))
    text = fresh(kept, "text")
    base = docs.select(*(carry or []), F.col(text_col).cast("string").alias(text))
    schema = kept.schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "lang_pred", "score"])
        give_back()

    return base.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Filter, least_score: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text some learned language explains: not `und`, score at least least_score."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = predict(renamed, model, f"c{names.index(text_col)}", [F.col(c) for c in renamed.columns])
    return kept.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).drop("lang_pred", "score").toDF(*names)
