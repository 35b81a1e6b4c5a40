"""Corrections by deletions against trying all edits."""

import itertools
import random

from quillframe.operators import spelling


def one_edit(w, letters="abcde"):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def test_edits_are_those_of_two_steps():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(0, 5)))
        near = one_edit(a)
        far = set().union(*(one_edit(x) for x in near))
        for b in rng.sample(sorted(far | {"".join(rng.choices("abc", k=4))}), 20):
            assert spelling.edits(a, b) == (0 if a == b else 1 if b in near else 2 if b in far else 3), (a, b)


def test_edits_of_all_short_words():
    words = ["".join(w) for n in range(5) for w in itertools.product("abc", repeat=n)]
    for a in words:
        near = one_edit(a, "abc")
        far = set().union(*(one_edit(x, "abc") for x in near))
        assert {b for b in words if spelling.edits(a, b) == 1} == near & set(words) - {a}, a
        assert {b for b in words if spelling.edits(a, b) == 2} == far & set(words) - near - {a}, a


def test_corrections(spark):
    rng = random.Random(2)
    known = {"".join(rng.choices("abcde", k=rng.randint(2, 7))): rng.randint(1, 5) for _ in range(150)}
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(200)]
    got = {r.word: r.correction for r in spelling.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(known.items()), "word string, n bigint")).collect()}
    for w in words:
        near = one_edit(w) & set(known)
        near = near or set().union(*(one_edit(x) for x in one_edit(w))) & set(known)
        assert got.get(w) == (None if w in known or not near else min(near, key=lambda x: (-known[x], x))), w


def test_texts(spark):
    dictionary = spark.createDataFrame([("income", 9), ("renewal", 5), ("form", 7)], "word string, n bigint")
    rows = [(1, "Teh  (incmoe) renewel, FROM 12a form!\n--"), (2, None), (3, ""), (1, "Form")]
    got = sorted((r.id, r.corrected, r.t) for r in spelling.corrected(spark.createDataFrame(rows, "id int, t string"), "t", dictionary).collect() if r.t)
    assert got == [(1, "form", "Form"), (1, "teh income renewal FROM 12a form", rows[0][1])]
    assert spelling.corrected(spark.createDataFrame(rows, "id int, t string"), "t", dictionary).filter("corrected = ''").count() == 2


def test_the_dictionary_is_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    dictionary = spark.createDataFrame([("income", 9), ("form", 7)], "word string, n bigint").mapInPandas(count, "word string, n bigint")
    got = spelling.corrected(spark.createDataFrame([(1, "incmoe form")], "id int, t string"), "t", dictionary).collect()
    assert got[0].corrected == "income form" and seen.value == 2


def test_forms_are_not_sent_to_the_driver(spark, tmp_path):
    spark.createDataFrame([("incmoe",)], "word string").write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([("income", 9), ("form", 7)], "word string, n bigint").write.parquet(f"{tmp_path}/dictionary")  # small files, as far as the plan can see
    got = spelling.corrections(spark.read.parquet(f"{tmp_path}/words"), spark.read.parquet(f"{tmp_path}/dictionary"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [form" in plan and "BroadcastHashJoin [form" not in plan
    assert [tuple(r) for r in got.collect()] == [("incmoe", "income")]
