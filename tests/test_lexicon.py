"""Phrases by the index against a search for one phrase after the other."""

import random
import re

import pytest

from quillframe.operators import entities, lexicon


def one_by_one(text, lexicon_):
    last, taken, out = {}, [], []
    for p, c, label in lexicon_:
        last[p.lower()] = (c, label)
    for p in sorted(last, key=len, reverse=True):
        for m in re.finditer(r"\b" + re.escape(p) + r"\b", text, re.IGNORECASE) if len(p) > 1 else ():
            if all(m.end() <= s or e <= m.start() for s, e in taken):
                taken.append(m.span())
                out.append((*m.span(), m.group(0), p, *last[p]))
    return sorted(out)


def test_longest_first_over_the_whole_text(spark):
    known = [("managed care", "MC", "a"), ("care coordination", "CC", "a"), ("section 1115", "S", "a"), ("1115 demonstration", "D", "a"), ("respite care", "R", "a")]
    df = spark.createDataFrame([(1, "managed care coordination here"), (2, "Section 1115 Demonstration"), (3, "respite care coordination"), (4, None), (5, "")], "id int, t string")
    got = {r.id: r.text for r in entities.lexicon_entities(df, "id", "t", known).collect()}
    assert got == {1: "care coordination", 2: "1115 Demonstration", 3: "care coordination"}


def test_random_texts_and_piece_borders(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "b", "care", "managed", "coordination", "1115", "section", "d-snp", "(c)", "é", "_x"]
    known = [(" ".join(rng.choices(words, k=rng.randint(1, 4))), f"C{i}", f"L{i}") for i in range(60)] + [("a b a", "ABA", "x"), ("1915(c)", "W", "y"), ("aged, blind", "AB", "z"), ("a", "short", "x")]
    texts = [" ".join(rng.choices([*words, "1915(c)x", "1915(c) x", "aged, blind", "A B A B A", "\n", "İ", "...", "ab"], k=rng.choice([0, 3, 20, 300]))) for _ in range(30)]
    df = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "id int, t string")  # ids repeat
    monkeypatch.setattr(lexicon, "PIECE", 60)
    got = sorted(tuple(r) for r in lexicon.lexicon_matches(df, "id", "t", known).collect())
    assert got == sorted((i % 20, *x) for i, t in enumerate(texts) for x in one_by_one(t, known))


def test_a_lexicon_of_100_000_phrases_is_a_table(spark):
    known = spark.range(100_000).selectExpr("concat('w', id, ' x', id % 7, if(id % 2 = 0, ' end', '')) as phrase", "cast(id as string) as canonical", "'L' as label", "id as place")
    text = " ".join(f"w{n} x{n % 7} end" for n in range(0, 100_000, 997))
    got = lexicon.lexicon_matches(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", known).collect()
    assert len(got) == 101 and {r.canonical for r in got} == {str(n) for n in range(0, 100_000, 997)}
    assert all(r.phrase.endswith("end") == (int(r.canonical) % 2 == 0) for r in got)
    plan = lexicon.lexicon_matches(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", known)._jdf.queryExecution().toString()
    assert "w997 " not in plan  # no phrase is in an expression


def test_a_phrase_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "PIECE", 10)
    with pytest.raises(ValueError, match="a phrase of 14 signs"):
        lexicon.lexicon_matches(spark.createDataFrame([(1, "x")], "id int, t string"), "id", "t", [("longer than it", "c", "l")])


def test_chunks_end_with_the_text(spark):
    df = spark.createDataFrame([("x" * n,) for n in (1, 1500, 1501, 2700, 2801, 4100)], "t string")
    assert [[c.offset for c in r.c] for r in df.select(entities.chunks(df.t).alias("c")).collect()] == [[0], [0], [0, 1300], [0, 1300], [0, 1300, 2600], [0, 1300, 2600]]
