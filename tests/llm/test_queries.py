"""The registered corpus queries, whole results on the small tables, against brute force."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from quillframe.llm import language_id, queries, secret_scan
from quillframe.llm import sentencepiece_codec as codec
from quillframe.llm.tokens import default_tokenizer

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def token_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(default_tokenizer())
    return {i: tok.encode(r["text"] or "", add_special_tokens=False).ids for i, r in texts.items()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def bits(a, b):
    return bin(a ^ b).count("1")


def test_op1_pieces_and_sequences(spark, token_ids):
    got = rows(spark, "op1_best_fit_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(token_ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        ids = [*token_ids[i], 0]
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 2048 for r in parts[1:]) and (len(parts) == 1 or len(ids) > 2048)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(by_sequence) <= 1.02 * least + 1


def test_op2_suffix_sums(spark, token_ids):
    lengths = [len(x) for x in token_ids.values()]
    got = {r.length: r for r in rows(spark, "op2_token_counts")}
    assert set(got) == set(lengths) | {512, 1024, 2048, 4096, 8192, 16384, 32768}
    for x, r in got.items():
        assert (r.docs, r.docs_longer, r.tokens_longer, r.truncated_tokens) == (lengths.count(x), sum(n > x for n in lengths), sum(n for n in lengths if n > x), sum(min(n, x) for n in lengths))
        assert r.quantile == pytest.approx(sum(n <= x for n in lengths) / len(lengths))


def test_op3_shards(spark, texts):
    got = rows(spark, "op3_sharding")
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 16
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(load.values()) / 16
    assert max(load.values()) - mean <= max(r.size for r in got)


def test_op4_components(spark, texts):
    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {i: fingerprint(r["text"]) for i, r in texts.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bits(fps[i], fps[j]) <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op4_simhash_dedup")} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_op5_findings(spark, texts):
    got = defaultdict(list)
    for r in rows(spark, "op5_secret_scan"):
        got[r.doc_id].append((r.start, r.length_chars, r.value_sha256, r.shown))
        assert 0 <= r.probability <= 1 and r.is_secret == (r.probability >= 0.5)
    for i, r in texts.items():
        want = []
        for m in regex.finditer(secret_scan.CANDIDATE, r["text"] or ""):
            lead = (regex.match(secret_scan._LEAD, m.group()) or [""])[0]
            user = re.match(r"[^\s/?#@:\"'<>]*:", m.group()) if r["text"][: m.start()].endswith("://") and r["text"][m.end() :].startswith("@") else None
            value = m.group()[len(user.group() if user else lead) :]
            want.append((m.end() - len(value), len(value), hashlib.sha256(value.encode()).hexdigest(), value[:4]))
        assert sorted(got[i]) == want, i


def test_op6_edits_and_counts(spark, texts):
    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        terms = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []
        hashes = [(xxhash.xxh64_intdigest(t.encode(), seed=42), min(len(t), 24)) for t in terms]
        return sum(1 << b for b in range(64) if 2 * sum(w for h, w in hashes if h >> b & 1) > sum(w for _, w in hashes))

    got = {r.doc_id: r for r in rows(spark, "op6_document_fingerprints")}
    order = sorted(texts, reverse=True)
    plain = {i: texts[i]["text"] or "" for i in order}
    fps = {i: fingerprint(t) for i, t in plain.items()}
    for i, j in zip(order, [*order[1:], order[0]]):
        half = len(plain[i]) // 2
        new = plain[i][: len(plain[i]) - half] + plain[j][:half]
        r, edited = got[i], fingerprint(new)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(plain[i]), hashlib.sha256(new.encode()).hexdigest(), f"{fps[i]:016x}", f"{edited:016x}")
        assert (r.near_edited, r.near_next) == (1 - bits(fps[i], edited) / 64, 1 - bits(fps[i], fps[j]) / 64)
        near = [f for f in fps.values() if bits(f, fps[i]) <= 3]
        assert (r.near_classes, r.near_documents) == ((len(set(near)), len(near)) if i % 100 == 0 else (None, None))


def test_op7_equals_the_library(spark, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.default_model())
    for r in rows(spark, "op7_sentencepiece"):
        text = texts[r.doc_id]["text"]
        if text is None:
            assert r.n_ids is None
            continue
        ids = sp.encode(text)
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<i4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def language_by_brute_force(labelled, text, slots, hashes, least_share):
    """Counts, masks, chance and decision, in plain Python. labelled: [(lang, text)]."""
    mask64 = (1 << 64) - 1

    def grams(t):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        s = re.sub(" +", " ", s)
        return [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]

    def places(g):
        x = 0
        for c in g:
            x = x << 21 | ord(c)
        x = (x + 0x9E3779B97F4A7C15) & mask64
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask64
        x ^= x >> 31
        return [((x & 0xFFFFFFFF) + i * (x >> 32 | 1)) % slots for i in range(hashes)]

    counts = defaultdict(Counter)
    for lang, t in labelled:
        counts[lang].update(grams(t))
    held = {}
    for lang in sorted(counts):
        total = sum(counts[lang].values())
        held[lang] = {p for g, n in counts[lang].items() if n >= total * least_share for p in places(g)}
    out = {}
    for i, t in text.items():
        if not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        gs, best = [places(g) for g in grams(t)], (None, -1.0)
        for lang in sorted(held):
            chance = (len(held[lang]) / slots) ** hashes
            share = min(max((sum(all(p in held[lang] for p in ps) for ps in gs) / max(len(gs), 1) - chance) / (1 - chance), 0.0), 1.0)
            best = (lang, share) if share > best[1] else best  # ties go to the language that sorts first
        out[i] = best
    return out


def test_op9_predictions(spark, texts):
    held_out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    got = {r.doc_id: r for r in rows(spark, "op9_language_id")}
    want = language_by_brute_force([(r["lang"], r["text"]) for i, r in texts.items() if not held_out[i] and r["lang"] is not None and r["text"] is not None], {i: r["text"] for i, r in texts.items()}, 1 << 17, 3, 1e-5)
    assert {i: r.held_out for i, r in got.items()} == held_out
    assert {i: r.lang_pred for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(r.score == pytest.approx(want[i][1], abs=1e-9) for i, r in got.items())


def test_op9_ties_and_chance(spark):
    """Two languages with the same texts: the first by name wins; a crowded filter corrects for chance."""
    rows_ = [(0, "der hund läuft", "de"), (1, "der hund läuft", "aa"), (2, "the dog runs", "en"), (3, "12", "en"), (4, None, "en"), (5, "dog der", None)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    model = language_id.learn(df, slots=64, hashes=2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model, carry=["doc_id"]).collect()}
    want = language_by_brute_force([(r[2], r[1]) for r in rows_ if r[1] and r[2]], {r[0]: r[1] for r in rows_}, 64, 2, 1e-5)
    assert got[0][0] == got[1][0] == "aa" and {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in got)
