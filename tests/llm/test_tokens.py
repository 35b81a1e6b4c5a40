"""Packing, token counts and the SentencePiece codec."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import packing, token_counts
from quillframe.llm import sentencepiece_codec as codec
from quillframe.llm.tokens import default_tokenizer, encoder

TEXTS = [None, "", " ", "short", "short", "é ☃ 😀\ttab\n\nline", "<|endoftext|> in text", "word " * 5000, "x" * 9000, "1234567890" * 50, "Ünïcödé 漢字 かな"]
SCHEMA = "doc_id bigint, text string, lang string, row bigint, length string, piece string"


def docs(spark, texts=TEXTS):
    rows = [(i, t, None, 3, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None)], SCHEMA).repartition(3)


def test_ids_are_those_of_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    slow, fast = tokenizers.Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for t in TEXTS[1:]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_pieces(spark):
    rows = packing.pack(packing.pieces(docs(spark), context=512), context=512).collect()
    encode = encoder(default_tokenizer())
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = [*encode(t or "").tolist(), 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        at = 0
        for r in mine:
            assert r.start == at and (r.length == 512 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
    used = check_places(rows, 512)
    assert used <= -(-sum(r.length for r in rows) // 512) + 1


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(packing.pieces(docs(spark), context=256, keep_ids=True), context=256)
    held = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert held[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert all(len(r.ids) == 4 * r.length for r in held.values())


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.pieces(empty)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    r = random.Random(seed)
    capacity = 100
    hist = Counter(r.choice([r.randint(1, 100), r.randint(30, 40), 100, 51]) for _ in range(2000))
    for share in (8, 4, 2):
        rows, used = packing.plan(dict(hist), capacity, 16, capacity // share)
        load, placed = Counter(), Counter()
        for length, first, end, sequence, each, _ in rows:
            placed[length] += end - first
            for k in range(end - first):
                load[sequence + k // each] += length
        assert placed == hist and max(load.values()) <= capacity and set(load) == set(range(used))
    best = packing.best_plan(dict(hist), capacity)[1]
    assert best <= 1.05 * max(-(-sum(k * v for k, v in hist.items()) // capacity), sum(v for k, v in hist.items() if k > 50))


def test_dearest_configuration_against_all():
    r = random.Random(5)
    for _ in range(30):
        sizes = sorted(r.sample(range(9, 60), 5))
        price = [r.random() * x for x in sizes]

        def best(room):
            return max([0.0] + [p + best(room - x) for x, p in zip(sizes, price) if x <= room])

        worth, count = packing.dearest(np.array(sizes), np.array(price), 70)
        assert abs(worth - best(70)) < 1e-9 and sum(c * x for c, x in zip(count, sizes)) <= 70 and abs(sum(c * p for c, p in zip(count, price)) - worth) < 1e-9


def test_configurations_beat_one_size_per_sequence():
    found = packing.configurations([60, 40], [10, 10], 100)
    assert abs(sum(x for _, x in found) - 10) < 0.01


def test_token_histogram_and_suffix_sums(spark):
    lengths = [len(encoder(default_tokenizer())(t or "")) for t in [*TEXTS, "no id"]]
    rows = token_counts.suffix_sums(token_counts.lengths(docs(spark))).collect()
    assert {r.length: r.docs for r in rows} == Counter(lengths)
    for r in rows:
        assert r.docs_longer == sum(n > r.length for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert abs(r.quantile - sum(n <= r.length for n in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 7, 1000, 10**6]
    told = {r.length: r for r in token_counts.suffix_sums(token_counts.lengths(docs(spark)), limits).collect()}
    assert set(told) == set(lengths) | set(limits)
    for x, r in told.items():
        assert r.docs == lengths.count(x) and r.truncated_tokens == sum(min(n, x) for n in lengths) and r.docs_longer == sum(n > x for n in lengths)


def test_counting_nothing(spark):
    empty = token_counts.lengths(spark.createDataFrame([], SCHEMA))
    assert token_counts.suffix_sums(empty).collect() == [] and token_counts.suffix_sums(empty, [5]).collect() == []


ODD = ["  a  b\nc é☃ \U0001f600 x▁y", "", " ", "a" * 3000, "ab\x00c￿d", "<0x0A><s></s><unk>", "x" * 41 + " " + "the" * 30, "İİ ﬁ", "   ", " lead", "trail ", "The quick brown fox. " * 40]


def test_codec_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model())
    mine = codec.Codec(codec.Vocabulary.read(codec.default_model()))
    ids = mine.encode(ODD)
    assert [list(struct.unpack(f"<{len(x) // 4}i", x)) for x in ids] == [sp.encode(t) for t in ODD]
    assert mine.decode(ids) == [sp.decode(sp.encode(t)) for t in ODD]


def test_codec_keeps_few_bytes(monkeypatch):
    """Long words are not kept, short ones within a bound, and what was dropped is encoded again."""
    whole = codec.Codec(codec.Vocabulary.read(codec.default_model()))
    monkeypatch.setattr(codec, "CACHE_BYTES", 2000)
    mine = codec.Codec(whole.v)
    texts = [f"word{i % 40} {'é' * (i % 150)} tail{i % 7}" for i in range(300)] + ODD
    for at in range(0, len(texts), 10):
        assert mine.encode(texts[at : at + 10]) == whole.encode(texts[at : at + 10])
        assert max(map(len, [*mine.known, *mine.older])) <= codec.KEPT_WORD and len(mine.known) + len(mine.older) < 150


def test_codec_frames(spark):
    df = spark.createDataFrame([*((i, t, "keep") for i, t in enumerate(ODD)), (99, None, None)], "doc_id bigint, text string, other string")
    both = codec.decode(codec.encode(df)).collect()
    assert {r.doc_id: r.decoded for r in both} == {**{i: t.replace("▁", " ") for i, t in enumerate(ODD)}, 99: None}
    assert all(r.other == "keep" for r in both if r.doc_id != 99)
    rows = {r.doc_id: r for r in codec.report(df).collect()}
    assert rows[99].n_ids is None and all(r.round_trip for i, r in rows.items() if i != 99)
    assert codec.report(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        codec.encode(df, ids_col="other")


def best_score(text, scores, floor):
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = scores.get(text[i:j], floor if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_unigram_relaxation_is_the_best_path():
    r = random.Random(1)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)} - {"c"})
    scores = {p: -r.random() * 5 for p in pieces}
    v = codec.Vocabulary(pieces, list(range(len(pieces))), [scores[p] for p in pieces], False, False, unk_id=1000)
    floor = min(scores.values()) - 10
    for _ in range(60):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        chunk = codec._Chunk([text], v)
        cuts = [*chunk.best_path(0).tolist(), len(text)]
        got = sum(scores.get(text[a:b], floor) for a, b in zip(cuts, cuts[1:]))
        assert abs(got - best_score(text, scores, floor)) < 1e-9
