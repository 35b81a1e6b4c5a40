"""SQLite tables with what is pushed into them, crop side-cars, reports with images, entities of chunks."""

import contextlib
import io
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillframe.operators import entities
from quillframe.sources import readers, sqlite, writers


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "jobs.db")
    db = sqlite3.connect(path)
    db.execute("create table jobs (id INTEGER PRIMARY KEY, title TEXT, score REAL, raw BLOB, made TIMESTAMP, \"odd name\" VARCHAR(9))")
    db.executemany("insert into jobs values (?, ?, ?, ?, ?, ?)", [(i, None if i % 10 == 0 else f"job {i % 7}", i / 4, bytes([i % 256]), f"2024-01-{i % 28 + 1:02d}", "x'y") for i in range(1, 501) if i % 13])
    db.execute("create table empty (a TEXT)")
    db.commit()
    db.close()
    return path


def test_sqlite_rows_and_types(spark, store):
    jobs = sqlite.table(spark, store, "jobs", 5)
    assert [(f.name, f.dataType.simpleString()) for f in jobs.schema.fields] == [("id", "bigint"), ("title", "string"), ("score", "double"), ("raw", "binary"), ("made", "string"), ("odd name", "string")]
    rows = jobs.collect()
    assert len(rows) == len({r.id for r in rows}) == 500 - 500 // 13 and jobs.rdd.getNumPartitions() == 5
    one = next(r for r in rows if r.id == 3)
    assert (one.title, one.score, bytes(one.raw), one.made, one["odd name"]) == ("job 3", 0.75, b"\x03", "2024-01-04", "x'y")
    assert sqlite.table(spark, store, "empty").collect() == [] and sqlite.table(spark, store, "empty").count() == 0
    with pytest.raises(Exception, match="no table nothing"):
        sqlite.table(spark, store, "nothing")


@pytest.mark.parametrize("condition, pushed", [
    ("id > 100 and id <= 200", True), ("title = 'job 3'", True), ("title is null", True), ("score >= 20.5 and title is not null", True), ("id in (1, 2, 14, 999)", True), ("`odd name` = 'x''y'", True),
    ("made >= '2024-01-20'", False), ("length(title) = 5", False), ("id % 2 = 0", False), ("title like '%3'", False), ("not (title = 'job 3')", False),
])
def test_sqlite_filters(spark, store, condition, pushed):
    jobs = sqlite.table(spark, store, "jobs", 3)
    got = jobs.filter(condition).select("id", "title")
    plain = spark.createDataFrame(jobs.collect(), jobs.schema).filter(condition)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in plain.collect())
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain("formatted")
    left = [line for line in out.getvalue().splitlines() if line.startswith("Condition")]
    assert bool(left) != pushed, out.getvalue()


def test_crops_of_jobs(spark, tmp_path):
    for job, text in {"job 1": '{"x": 1, "y": 2, "w": 3,\n "h": 4}', "job2": '{"x": 1, "y": 2}', "j3": json.dumps({"x": 5, "y": 6, "w": 7, "h": 8, "more": 1})}.items():
        (tmp_path / "jobs" / job).mkdir(parents=True)
        (tmp_path / "jobs" / job / "crop.json").write_text(text)
    found = readers.crops(spark, str(tmp_path / "jobs"))
    assert sorted(map(tuple, found.collect())) == [("j3", 5, 6, 7, 8), ("job 1", 1, 2, 3, 4)]
    jobs = spark.createDataFrame([("job 1",), ("job2",)], "id string")
    assert {r.id: r.crop and tuple(r.crop) for r in readers.cropped(jobs, found, "id").collect()} == {"job 1": (1, 2, 3, 4), "job2": None}


def test_report_with_images(spark):
    captures = spark.createDataFrame([(1, 1, 2, bytearray(b"\x89PNG"), "a/b.jpeg", 65_000, "Head <1>", "Sum", ["k&1"], None), (1, 2, 5, None, "gone.png", None, None, None, None, "note")],
        "id int, ord int, bucket int, image binary, image_path string, captured_at_ms bigint, heading string, summary string, key_points array<string>, notes string")
    jobs = spark.createDataFrame([(1, "R & R", None), (2, "", "TX")], "id int, recipient string, state string")
    html = {r.id: r.html for r in writers.capture_report(captures, jobs, "id", "ord").collect()}
    assert "<b>Recipient</b> R &amp; R" in html[1] and "<b>State</b> not provided" in html[1] and "<b>State</b> TX" in html[2] and html[2].count("not provided") == 5
    assert '<img src="data:image/jpeg;base64,iVBORw==">' in html[1] and "Captured at 01:05" in html[1] and "Head &lt;1&gt;" in html[1] and "<li>k&amp;1</li>" in html[1]
    assert "Image not available" in html[1] and html[2].count("<section>") == 5 and html[1].index("Program") < html[1].index("<img") < html[1].index("Eligibility Evidence")


def test_chunks_of_a_long_text_find_an_entity_once(spark):
    def tagger(batch):
        if "BROKEN" in batch[0]:
            raise RuntimeError("model failed")
        return [[(w, kind, score) for w, kind, score in (("Ana Perez", "person", 0.9), ("renewal", "step", 0.8), ("weak", "person", 0.1), ("other", "no label", 0.9)) if w.lower() in c.lower()] for c in batch]

    filler = "lorem " * 20_000
    at = 1300 * 40 + 150  # in the overlap of two chunks
    text = filler[:at] + " ANA PEREZ weak other " + filler[at:] + " renewal"
    across = "x" * 1495 + " Ana Perez " + "y" * 3000  # over the end of the first chunk, whole in the second
    df = spark.createDataFrame([(1, text), (2, across), (3, "BROKEN Ana Perez"), (4, None), (5, "")], "id int, t string")
    got = sorted((r.id, r.start, r.text, r.label, r.canonical_name, r.confidence) for r in entities.chunk_layer(df, "id", "t", tagger, {"person": "PERSON", "step": "STEP"}).collect())
    assert got == [(1, at + 1, "Ana Perez", "PERSON", "ANA_PEREZ", 0.9), (1, len(text) - 7, "renewal", "APPLICATION_PROCESS", "ELIGIBILITY_REVIEW", 0.8), (2, 1496, "Ana Perez", "PERSON", "ANA_PEREZ", 0.9)]
    found = entities.chunk_layer(df, "id", "t", tagger, {"person": "PERSON"})
    known = spark.createDataFrame([(2, 1490, 1500, "first", "KNOWN")], "id int, start int, end int, text string, label string")
    assert [(r.id, r.label) for r in entities.layered([known, found], "id").filter("id = 2").collect()] == [(2, "KNOWN")]
