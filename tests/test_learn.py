"""Fitted models: stored vocabularies, probabilities, the kernel."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillframe.operators import classify, learn


def test_tf_idf_fit_save_transform(spark, tmp_path):
    seen = [(1, "apple pie and apple cake"), (2, "pie crust"), (3, "cake, cake! apple"), (4, "nothing else")]
    df = spark.createDataFrame(seen, "id int, t string")
    model = learn.TfIdf.fit(df, "id", "t")
    assert [(r.position, r.word, r.df) for r in model.vocabulary.orderBy("position").collect()] == [(0, "apple", 2), (1, "cake", 2), (2, "pie", 2)]
    path = str(tmp_path / "words")
    assert (model.save(path), learn.TfIdf.fit(df.limit(0), "id", "t").save(path)) == (0, 1)
    again = learn.TfIdf.load(spark, path, 0)
    new = spark.createDataFrame([(7, "Apple apple pie unknown"), (8, "nothing"), (9, None)], "id int, t string")
    got = {r.id: r for r in again.summaries(new, "id", "t").collect()}
    idf = math.log(5 / 3) + 1
    norm = math.sqrt((2 * idf) ** 2 + idf**2)
    assert got[7].vocab_size == 2 and [k.word for k in got[7].keywords] == ["apple", "pie"] and got[7].vector == pytest.approx([2 * idf / norm, 0, idf / norm])
    assert got[8].vocab_size == got[9].vocab_size == 0 and got[8].vector == [0.0] * 3 and got[9].keywords == []


def test_pipeline_weights_are_tf_idf_plus_one(spark):
    rows = [(i, text) for i, text in enumerate(["red apple", "red red pear", "green apple pear", "red apple apple"])]
    df = spark.createDataFrame(rows, "id int, t string")
    words = learn.text_features(df, "t")
    got = {r.id: dict(zip(words.stages[2].vocabulary, r._f.toArray())) for r in words.transform(df).collect()}
    want = {(r.id, r.word): r.weight for r in learn.TfIdf.fit(df, "id", "t").weights(df, "id", "t").collect()}
    assert all(got[i][w] == pytest.approx(x) for (i, w), x in want.items()) and len(want) == sum(x > 0 for g in got.values() for x in g.values())


def _labelled(spark, n, kinds):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        kind = kinds[i % len(kinds)]
        words = [kind + str(rng.integers(5)) if rng.random() < 0.4 else "noise" + str(rng.integers(20)) for _ in range(12)]
        rows.append((i, kind, " ".join(words)))
    return spark.createDataFrame(rows, "id int, label string, text string")


@pytest.mark.parametrize("kinds", [["yes", "no"], ["aa", "bb", "cc"]])
def test_calibrated_probabilities(spark, tmp_path, kinds):
    df = _labelled(spark, 150, kinds)
    words = learn.text_features(df, "text")
    ready = words.transform(df).select("id", "label", "_f")
    model = learn.CalibratedSvm.fit(ready.filter("id < 120").coalesce(1), "label", "id", k=2, iterations=10)
    model.save(str(tmp_path / "svm"), spark)
    again = learn.CalibratedSvm.load(str(tmp_path / "svm"), spark)
    got = again.probabilities(ready.filter("id >= 120")).collect()
    assert all(sum(r.probabilities.values()) == pytest.approx(1) and set(r.probabilities) == set(kinds) for r in got)
    assert sum(max(r.probabilities, key=r.probabilities.get) == r.label for r in got) >= 27
    same = {r.id: r.probabilities for r in model.probabilities(ready.filter("id >= 120")).collect()}
    assert all(same[r.id] == pytest.approx(r.probabilities) for r in got)
    mean = Counter()
    for r in got:
        mean[r.label] += r.probabilities[r.label] / 30
    assert sum(mean.values()) > 0.75  # sure where it is right


def test_predictions_of_unseen_folds(spark):
    df = _labelled(spark, 90, ["yes", "no"])
    got = learn.calibrated_predictions(df.coalesce(1), "label", "id", "text", k=2).withColumn("r", classify.with_reject(F.col("probabilities"))).collect()
    assert sorted(r.id for r in got) == list(range(90)) and set(Counter(r.fold for r in got).values()) == {44, 46}  # each label's odd row goes to the first fold
    assert sum(r["r"].label == r.label for r in got) > 70


def test_fourier_features_part_rings(spark):
    """A disc inside a ring is no matter of a line; products of the features approach the kernel."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        radius, angle = (0.6, 2.0)[i % 2] * rng.uniform(0.8, 1.2), rng.uniform(0, 6.3)
        rows.append((i, "out" if i % 2 else "in", float(radius * np.cos(angle)), float(radius * np.sin(angle))))
    df = spark.createDataFrame(rows, "id int, label string, x double, y double")
    pipeline, vector = learn.fourier_features(df, ["x", "y"])
    ready = pipeline.transform(df).withColumn("_f", vector)
    sample = ready.orderBy("id").limit(30).collect()
    for a in sample[:8]:
        for b in sample[8:16]:
            assert float(a._f.dot(b._f)) == pytest.approx(math.exp(-0.5 * float(np.sum((a._s.toArray() - b._s.toArray()) ** 2))), abs=0.25)
    model = learn.CalibratedSvm.fit(ready.filter("id < 180").select("id", "label", "_f").coalesce(1), "label", "id", k=2, iterations=15)
    got = model.probabilities(ready.filter("id >= 180")).collect()
    assert sum(max(r.probabilities, key=r.probabilities.get) == r.label for r in got) >= 57


def test_vectors_are_filled_by_position(spark):
    """As many words as a text has are placed; no map is made anew for each of the vocabulary's positions."""
    df = spark.createDataFrame([(1, "bb dd dd"), (2, "cc bb"), (3, "dd cc"), (4, ""), (5, None), (6, "aa"), (7, "aa ee"), (8, "ee bb")], "id int, t string")
    model = learn.TfIdf.fit(df, "id", "t", stop=[])
    told = model.summaries(df, "id", "t")
    assert "map_from_entries" not in told._jdf.queryExecution().toString()
    weights = {(r.id, r.position): r.weight for r in model.weights(df, "id", "t").collect()}
    assert {r.id: r.vector for r in told.collect()} == {i: [weights.get((i, p), 0.0) for p in range(5)] for i in range(1, 9)}


def test_rare_words_are_not_shuffled_with_their_rows(spark):
    """The vocabulary is joined below the count per row; what is left out (words of one row, missing keys) is as before."""
    rows = [(1, "aa bb bb"), (1, "cc cc"), (2, "aa dd"), (None, "ee"), (None, "ee ff"), (3, "ff")]
    told = classify.tf_idf(spark.createDataFrame(rows, "id long, t string"), "id", "t", stop=[])
    assert sorted((r.id or 0, r.word, r.tf, r.df) for r in told.collect()) == [(0, "ff", 1, 2), (1, "aa", 1, 2), (2, "aa", 1, 2), (3, "ff", 1, 2)]
    plan = told._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "Aggregate [id#" in line)
    assert "Join Inner" in "\n".join(plan[first + 1:first + 4])


def test_texts_are_cut_and_dealt_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(i, "ab"[i % 2], f"{'red blue' if i % 2 else 'green grey'} word{i % 3}") for i in range(36)]
    df = spark.createDataFrame(rows, "id long, y string, t string").mapInPandas(count, "id long, y string, t string")
    model = type("Model", (), {"probabilities": lambda self, rows: rows.withColumn("probabilities", F.create_map(F.lit("a"), F.get(vector_to_array("_f"), F.lit(0))))})
    monkeypatch.setattr(learn.CalibratedSvm, "fit", staticmethod(lambda *a, **k: model()))
    told = learn.calibrated_predictions(df, "y", "id", "t", k=2).collect()
    assert {r.id for r in told} == set(range(36)) and len(told) == 36
    assert seen.value <= 3 * 36  # the windows and counts of one dealing, whatever the number of fits
