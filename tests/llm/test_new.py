"""Byte-level BPE, periodic runs and conversation repair against tiktoken and brute force, and odd inputs."""

import hashlib
import os
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import byte_bpe, conversations, queries, runs

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tiktoken_ids():
    tiktoken = pytest.importorskip("tiktoken")
    e = tiktoken.Encoding("test", pat_str=byte_bpe.default_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={})
    return e.encode_ordinary


# --- byte-level BPE


def test_op11_equals_tiktoken(spark, tiktoken_ids):
    docs = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    got = queries.QUERIES["op11_byte_bpe"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tiktoken_ids(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(docs[r.doc_id]), True)


def test_bpe_random_texts(tiktoken_ids):
    c, rng = byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern()), random.Random(5)
    parts = ["a", "aa", "é", " ", "\n", "\t", "\x1c", "\x85", "'s", "'S", "1", "--", "=", "語", "😀", "́", "the", " in", ".", "  ", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [rng.choice("aebx=-*#_ .0é語\n") * rng.randint(1, 300) + rng.choice(parts) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    for text, ids in zip(texts, c.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_ids(text), text
        assert c.decode([ids]) == [text.encode()]
        starts, ends = byte_bpe.spans(text.encode(), c.sizes(ids)) if text else ([], [])
        assert "".join(byte_bpe.token_texts(text.encode(), c.sizes(ids))) == text
        assert all(token in text[a:b].encode() for token, a, b in zip(c.decode([ids[i : i + 4] for i in range(0, len(ids), 4)]), starts, ends))


def test_bpe_operators(spark):
    rows = [(1, "a😀語é b", 7), (1, "a😀語é b", 7), (None, None, None), (3, "", 1), (4, "x " * 50_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    got = byte_bpe.decode(byte_bpe.encode(docs)).orderBy("doc_id").collect()
    assert byte_bpe.encode(docs).columns == ["doc_id", "text", "ids", "starts", "ends"]
    assert [r.decoded for r in got] == [r.text for r in got] and got[0].ids is None and len(got[3].ids if got[3].doc_id == 3 else got[1].ids) >= 0
    a = next(r for r in got if r.doc_id == 1)
    assert a.starts[0] == 0 and a.ends[-1] == 6 and all(x <= y for x, y in zip(a.starts, a.starts[1:])) and list(zip(a.starts, a.ends)).count((1, 2)) >= 2  # the emoji's tokens all cover it
    assert "".join(byte_bpe.decode(byte_bpe.encode(docs), text_col="parts", pieces=True).filter("doc_id = 1").first().parts) == a.text
    cut = spark.createDataFrame([(a.ids[: a.starts.index(1) + 1],)], "ids array<int>")
    assert byte_bpe.decode(cut).first().decoded == "a�"
    assert byte_bpe.report(docs.limit(0)).collect() == []
    null = byte_bpe.report(docs.filter("doc_id is null")).first()
    assert (null.n_tokens, null.ids_sha256, null.decoded_sha256) == (0, sha(""), sha(""))
    assert byte_bpe.report(docs.filter("doc_id = 1")).first().split_tokens > 0
    with pytest.raises(Exception, match="without a token"):
        byte_bpe.decode(spark.createDataFrame([([1 << 30],)], "ids array<int>")).collect()


# --- periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(words):
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_whole_table(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    docs = {r["doc_id"]: r["text"] for r in table("documents")}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert tuple(r)[1:] == brute_row(brute_words(i, docs[i])), i
    assert sum(r.n_runs > 0 for r in got.values()) > 5


def test_runs_random_words():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters, t = rng.choice(["a", "ab", "abc", "abcdefgh"]), []
            while len(t) < rng.randint(0, 60):
                t += [rng.choice(letters) for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 2, 4, 5, 9])
            texts.append(t)
        number = {}
        words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int32)
        text, start, length, period = runs.find(words, np.array([len(t) for t in texts], dtype=np.int64))
        for k, t in enumerate(texts):
            assert list(zip(start[text == k].tolist(), length[text == k].tolist(), period[text == k].tolist())) == brute_runs(t)


def test_runs_odd_inputs(spark):
    rows = [(1, "a b " * 4000, 1), (None, "x " * 7, 2), (2, None, 3), (3, "", 4), (4, " \x0b\f ", 5), (5, "x\x85x\x1cx x x x x x", 6), (5, "x\x85x\x1cx x x x x x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = runs.report(docs).collect()
    assert sorted((r.n_runs, r.length or 0) for r in got) == [(0, 0)] * 5 + [(1, 7), (1, 8000)]  # \x85 and \x1c are no white space
    assert runs.report(docs.limit(0)).collect() == []
    back = {(r.doc_id, r.n_runs): r.text for r in runs.collapse(docs).collect()}
    assert back[1, 1] == "a b" and back[None, 2] == "x" and back[2, 3] is None and back[4, 5] == " \x0b\f "
    assert runs.edited(None, [b"a"] * 9) == [b"a"] * 9


# --- conversation repair

LEGAL = re.compile(r"(s?(ua)+)?")


def brute_damage(turns):
    out = []
    for t in turns:
        show = [" " if t[c] is None else str(t[c]) for c in ("conv_id", "turn", "role", "text")]
        fault, role, text = zlib.crc32(":".join(show[:2]).encode()) % 20, show[2], show[3]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(t["conv_id"], t["turn"], "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All ways by a table over (state reached, turns done): a state is the string of initials, shortened to what matters."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "", ())}

    def inserted(at):
        for _ in range(3):
            for (a, r), b in step.items():
                if a in at and r != "s":
                    x = (at[a][0] + 3, at[a][1] + "I", (*at[a][2], ("user" if r == "u" else "assistant") + ":"))
                    at[b] = min(x, at.get(b, x), key=lambda x: x[:2])
        return at

    for (role, text), fault in zip(rows, found):
        then = {}

        def put(b, x):
            then[b] = min(x, then.get(b, x), key=lambda x: x[:2])

        for a, (cost, audit, lines) in inserted(now).items():
            put(a, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for (x, r), b in step.items():
                    if x == a and role[:1] == r:
                        put(b, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                    if x == a and r != "s":
                        put(b, (cost + more + 3, audit + "R", (*lines, ("user" if r == "u" else "assistant") + f":{text}")))
        now = then
    return min((x for s, x in inserted(now).items() if s in ("", "a")), key=lambda x: x[:2])


def brute_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns, pairs = [r[1] for r in rows if r[1] is not None], [r[2:] for r in rows]
    found = faults(pairs)
    cost, audit, lines = cheapest(pairs, found) if rows else (0, "", ())
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, sha("\n".join(lines)))


def expected(turns):
    rows = brute_damage(turns)
    return {c: brute_conversation([r for r in rows if r[0] == c]) for c in {t["conv_id"] for t in turns}}


def test_op13_whole_table(spark):
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, DATA).collect()}
    assert got == expected(table("conversations"))


def test_matrices_try_everything():
    """All sequences of edits of short conversations, with up to two inserts at each place."""
    rng = random.Random(1)
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["ok.", "cut", "", f"{rng.random()}."])) for _ in range(rng.randint(0, 4))]
        found = faults(rows)
        ways = [("", "", 0)]
        for (role, _), fault in zip(rows, found):
            more, options = 3 * (fault == "truncated"), [("D", "", 4)]
            if fault not in ("blank", "duplicate"):
                options += [("K", role[0], more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
            inserts = [("I" * k, "".join(p), 3 * k) for k in range(3) for p in product("ua", repeat=k)]
            ways = [(a + i + o, r + x + y, c + d + e) for a, r, c in ways for i, x, d in inserts for o, y, e in options]
            ways = [w for w in ways if any(LEGAL.fullmatch(w[1] + end) for end in ("", "u", "a", "ua"))]
        ways = [(a + i, r + x, c + d) for a, r, c in ways for i, x, d in [("I" * k, "".join(p), 3 * k) for k in range(3) for p in product("ua", repeat=k)]]
        least = min((c, a) for a, r, c in ways if LEGAL.fullmatch(r))
        kinds = "".join(chr(65 + 3 * ("sua".find(r[0]) if r[0] in "sua" else 3) + {"": 0, "truncated": 1}.get(f, 2)) for (r, _), f in zip(rows, found))
        if kinds:
            assert conversations.best(conversations.span_matrix(kinds)) == least == cheapest(rows, found)[:2]


def test_odd_conversations(spark, monkeypatch):
    """Small spans, so that conversations go through several rounds; null ids, turns, roles and texts; repeated rows; strange roles."""
    monkeypatch.setattr(conversations, "SPAN", 4)
    monkeypatch.setattr(conversations, "FAN", 2)
    rng = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "unknown"]
    rows = [(rng.choice([1, 1, 1, 2, 3, None, *range(10, 40)]), rng.choice([None, *range(300)]), rng.choice(roles), rng.choice(["Yes.", "No", " ", None, "Why? \n", f"t{rng.random()}."])) for _ in range(700)]
    rows += [(1, 1000, "user", "Again.")] * 40 + [(50, t, "user", "x.") for t in range(100) if zlib.crc32(f"50:{t}".encode()) % 20 == 0][:2] + [(51, None, "user", "hm"), (52, None, None, None)]
    turns = [dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, audit string").repartition(3)
    assert {r.conv_id: tuple(r)[1:] for r in conversations.report(df).collect()} == expected(turns)
    assert conversations.report(df.limit(0)).collect() == []


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (2, 1, "system", "Be good."), (2, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    repair = conversations.Repair(turns.withColumn("copy", F.lit(0)))
    got = [tuple(r) for r in repair.turns.orderBy("conv_id", "ordinal").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Are you there?"), (2, 0, "K", "system", "Be good."), (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "Yes.")]
    assert {(r.conv_id, r.cost, r.audit) for r in repair.conversations.collect()} == {(1, 3, "KR"), (2, 3, "KIK")}
    repair.close()
