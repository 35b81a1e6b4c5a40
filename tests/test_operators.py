"""Golden cases and properties of the operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillframe.functions import rules, spans
from quillframe.functions.text import clean_ocr
from quillframe import plugins
from quillframe.operators import batch, classify, entities, layout, lookups, scoring, search, structure, timeseries
from quillframe.sources import readers, video, writers


def found(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(entities.extract(F.col("t")).alias("e")).first()
    return [(e.type, e.text, e.start, e.end) for e in row.e]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SSN 123-45-6789", ("ssn", "***-**-6789", 4, 15)),
        ("pay $2450 now", ("currency", "$245", 4, 8)),
        ("IL 62701", ("zip_code", "62701", 3, 8)),
        ("NPI: 1234567890", ("npi", "1234567890", 5, 15)),
        ("NPI1234567890", ("npi", "1234567890", 3, 13)),
        ("x National   Provider ID ##:::::::: 1234567890", ("npi", "1234567890", 36, 46)),
        ("due 03/15/2024 ok", ("date", "03/15/2024", 4, 14)),
        ("mail a.b@c.org!", ("email", "a.b@c.org", 5, 14)),
        ("at 10:30 PM", ("time_value", "10:30 PM", 3, 11)),
        ("Acme Widgets LLC", ("organization", "Acme Widgets LLC", 0, 16)),
        ("born in New Mexico", ("state", "New Mexico", 8, 18)),
        ("é 😀 12.5% up", ("percentage", "12.5%", 4, 9)),
    ],
)
def test_entity(spark, text, expected):
    assert expected in found(spark, text)


def test_entities_do_not_overlap(spark):
    es = found(spark, "Case # 12345, John Smith, 12 Main Street, Springfield, IL 62701, call (555) 123-4567 by 5 May 2024 or POL-123456")
    assert es == sorted(es, key=lambda e: e[2])
    assert all(a[3] <= b[2] for a, b in zip(es, es[1:]))


def test_no_entities(spark):
    assert found(spark, "see #12345") == []
    assert found(spark, "") == []


def test_person_names_exclude_title_words(spark):
    assert ("person_name", "Maria Lopez", 0, 11) in found(spark, "Maria Lopez")
    assert not [e for e in found(spark, "Total Amount") if e[0] == "person_name"]


def test_spans_and_resolution_of_long_lists(spark):
    """Beyond one part of a running total, with characters of several bytes and the signs that mark matches."""
    r = random.Random(4)
    texts = ["", None, "none", "7", "é1😀22x", "a" + spans.OPEN + "1b" + spans.CLOSE + "2", "".join(str(r.randint(0, 999)) + r.choice(["x", "é", "😀 "]) for _ in range(1000))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(spans.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert [[tuple(x) for x in g.s or []] for g in got] == [[(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t or "")] for t in texts]

    def greedy(items):
        kept = []
        for s, e, i in sorted(items, key=lambda x: (x[0] - x[1], x[2])):
            kept += [(s, e, i)] * all(not (s < b and a < e) for a, b, _ in kept)
        return sorted(kept)

    cases = [[(s := r.randint(0, m), s + r.randint(1, 12), i) for i in range(n)] for n, m in ((0, 1), (1, 5), (9, 20), (100, 60), (600, 3000))]
    done = spark.createDataFrame([(c,) for c in cases], "x array<struct<start:int,end:int,i:int>>").select(spans.resolve(F.col("x"), "struct<start:int,end:int,i:int>").alias("y")).collect()
    assert [[tuple(x) for x in d.y] for d in done] == [greedy(c) for c in cases]


def test_keyword_relevance(spark):
    df = spark.createDataFrame([("Income and household form",), ("",), (None,)], "t string")
    rows = df.select(scoring.matched_keywords(F.col("t"), ["income", "household", "form", "benefit"]).alias("m"), scoring.keyword_relevance(F.col("t"), ["income", "household", "form", "benefit"]).alias("s")).collect()
    assert rows[0].m == ["income", "household", "form"] and rows[0].s == 1.0
    assert rows[1].s == rows[2].s == 0.0


def test_rule_classes(spark):
    df = spark.createDataFrame([("Name, address and phone", 0.0), ("wages and salary", 0.0), ("nothing", 0.0), ("row and column total", 0.9)], "t string, s double")
    got = [r.c.section_type for r in df.select(scoring.classify_by_rules(F.col("t"), F.col("s")).alias("c")).collect()]
    assert got == ["demographics", "income", "unknown", "table"]


def test_bucket_prefers_the_label(spark):
    df = spark.createDataFrame([("income", None), ("income", "Case List"), ("x", "y")], "s string, l string")
    assert [r[0] for r in df.select(scoring.report_bucket(F.col("s"), F.col("l"))).collect()] == [2, 1, 5]


def test_empty_buckets_are_counted(spark):
    df = spark.createDataFrame([(2,), (2,), (5,)], "bucket int")
    assert {r.bucket: r.n for r in scoring.bucket_counts(df).collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 1}


def test_window_boundaries(spark):
    df = spark.createDataFrame([("j", 0, 1.0, 0), ("j", 3999, 2.0, 1), ("j", 4000, 2.0, 2), ("j", 4000, 2.0, 3), ("j", 9000, 0.0, 4)], "job string, ts bigint, score double, ord int")
    got = timeseries.best_per_window(df, "job", "ts", "score", 4000, "ord").orderBy("ts").collect()
    assert [(r.window_start, r.ord) for r in got] == [(0, 1), (4000, 2), (9000, 4)]


def test_change_detector_cooldown_and_unreadable():
    steps = [(0, 0.0), (1999, 250.0), (2000, 250.0), (2500, None), (5000, 250.0)]
    state, out = None, []
    for ts, v in steps:
        state, score, changed = timeseries.change_step(state, ts, v, timeseries.scalar_likeness(300.0))
        out.append((round(score, 4), changed))
    assert [c for _, c in out] == [True, False, True, False, False]
    assert out[3] == (0.0, False) and out[4][0] == 0.0


def test_second_pass_decides_between_the_limits():
    def run(rough, fine):
        state = timeseries.change_step(None, 0, "a", None)[0]
        return timeseries.change_step(state, 5000, "b", lambda a, b: rough, lambda a, b: fine)[1:]

    assert run(0.96, 0.0) == (0.04, False) and run(0.59, 1.0) == (0.41, True)  # the first pass is sure
    assert run(0.95, 0.84) == (0.16, True) and run(0.6, 0.86) == (0.14, False)
    assert run(0.7, -0.5) == (1.5, True)


def test_adaptive_sampler():
    like = {("a", "b"): 0.99, ("a", "c"): 0.9, ("c", "d"): 0.95, ("d", "e"): 0.98}
    state, kept = None, []
    for ts, v in [(0, "a"), (1999, "c"), (2000, "b"), (3999, "c"), (4000, "c"), (5499, "d"), (5500, "d"), (7499, "e"), (7500, "e"), (9500, None)]:
        state, take = timeseries.sample_step(state, ts, v, lambda a, b: like[a, b], 2000)
        if take:
            kept.append(ts)
    # 2000 is like the kept one: the next look is at 4000. There much changed: the next look is 1500 later. 0.98 is not over 0.98.
    assert kept == [0, 4000, 5500, 7500, 9500]


def test_folds_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(f"j{i % 2}" if i < 80 else None, i * 500, float(i % 11), i) for i in range(90)], "job string, ts bigint, v double, ord bigint")
        got = sorted((r.job or "", r.ord) for r in timeseries.sample_adaptive(df, "job", "ts", "v", "ord", 2000, timeseries.scalar_likeness(100.0)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for job in ("j0", "j1", ""):
        state = None
        for i in range(90):
            if job == (f"j{i % 2}" if i < 80 else ""):
                state, take = timeseries.sample_step(state, i * 500, float(i % 11), timeseries.scalar_likeness(100.0), 2000)
                want += [(job, i)] * take
    assert got == sorted(want)


def test_greedy_distinct_is_maximal(spark):
    df = spark.createDataFrame([("j", float(i % 5), i, i * 37 % 64) for i in range(40)], "job string, score double, ord int, item bigint")
    like = lambda a, b: 1 - F.bit_count(a.bitwiseXOR(b)) / 6
    kept = {r.ord: r.item for r in timeseries.greedy_distinct(df, "job", "score", "ord", "item", like, 0.8).collect()}
    same = lambda a, b: 1 - bin(a ^ b).count("1") / 6 >= 0.8
    assert all(not same(a, b) for i, a in kept.items() for j, b in kept.items() if i < j)
    assert all(any(same(i * 37 % 64, k) for k in kept.values()) for i in range(40))


def test_list_flush_of_one_item(spark):
    df = spark.createDataFrame([(1, "- a\n1. b\n2. c\n\n- alone\ntext")], "id int, t string")
    got = structure.lists(df, "id", "t").orderBy("start_line").collect()
    assert [(r.type, r["items"]) for r in got] == [("bulleted", ["a"]), ("numbered", ["b", "c"])]


def test_key_values(spark):
    df = spark.createDataFrame([(1, "Name: John\nStatus | Active\n9x: no\nName: Jane\nIncome ..... $5\nOdd: v")], "id int, t string")
    got = {(r.name, r.value): r.is_known_field for r in structure.key_values(df, "id", "t").collect()}
    assert got == {("Name", "John"): True, ("Status", "Active"): True, ("Income", "$5"): True, ("Odd", "v"): False}


def test_headers(spark):
    df = spark.createDataFrame([(1, "ELIGIBILITY NOTICE\nPlain text here\nIncome And Assets\nTotal: 5\nABC\nA Title.")], "id int, t string")
    assert [r.header for r in structure.headers(df, "id", "t").orderBy("line_num").collect()] == ["ELIGIBILITY NOTICE", "Income And Assets"]


def test_clean_ocr(spark):
    df = spark.createDataFrame([("a\x00b     c\n|\nX\n\n\n\n\nend ",)], "t string")
    assert df.select(clean_ocr(F.col("t"))).first()[0] == "ab  c\nX\n\n\nend"


def test_lexicon(spark):
    lexicon = [("hospital", "HOSPITAL", "CARE_SETTING"), ("hospital", "HOSPITAL", "PROVIDER_TYPE"), ("general hospital", "GH", "CARE_SETTING"), ("renewal", "RENEWAL", "X"), ("1915(c)", "W", "WAIVER_OR_AUTHORITY")]
    df = spark.createDataFrame([(1, "General Hospital, hospital; renewal 1915(c) x")], "id int, t string")
    got = [(r.text, r.label, r.canonical_name) for r in entities.lexicon_entities(df, "id", "t", lexicon).orderBy("start").collect()]
    assert got == [("General Hospital", "CARE_SETTING", "GH"), ("hospital", "PROVIDER_TYPE", "HOSPITAL"), ("renewal", "APPLICATION_PROCESS", "ELIGIBILITY_REVIEW")]


def test_search_shows_a_reference_once(spark):
    a = spark.createDataFrame([("r1", "form form", 0)], "ref string, text string, ord int")
    b = spark.createDataFrame([("r1", "form", 0), ("r2", "FORM form form", 1)], "ref string, text string, ord int")
    got = [(r.ref, r.source, r.match_count) for r in search.search([(a, "shots"), (b, "frames")], " Form ", "ref", "text", "ord").collect()]
    assert got == [("r2", "frames", 3), ("r1", "shots", 2)]


def test_search_finds_a_frame_whose_screenshot_lacks_the_word(spark):
    a = spark.createDataFrame([("r1", "nothing here", 0), ("r2", "form", 1)], "ref string, text string, ord int")
    b = spark.createDataFrame([("r1", "a form", 0), ("r2", "form form", 1)], "ref string, text string, ord int")
    got = [(r.ref, r.source) for r in search.search([(a, "shots"), (b, "frames")], "form", "ref", "text", "ord").collect()]
    assert sorted(got) == [("r1", "frames"), ("r2", "shots")]


def test_titles_look_at_the_first_fifty_frames(spark):
    rows = [("a", i, None if i < 49 else "Eligibility Review" if i == 49 else "Later Words") for i in range(60)] + [("b", i, "" if i < 50 else "Too Late") for i in range(60)]
    df = spark.createDataFrame(rows, "job string, ord int, text string")
    assert {r.job: r.title for r in search.title_words(df, "job", "text", "ord").collect()} == {"a": "Eligibility Review"}


def test_last_duplicate_frame_counts(spark):
    shots = spark.createDataFrame([("j", "frame_000001", "s")], "job string, ref string, shot string")
    frames = spark.createDataFrame([("j", 1, "old", 0), ("j", 1, "new", 1)], "job string, idx int, text string, ord int")
    assert lookups.left_by_ref(shots, frames, "job", "idx", "ref", "ord").select("frame.text").first()[0] == "new"


def test_best_strategy_stops_early(spark):
    df = spark.createDataFrame([(1, 0, 0, 80.0, 10), (1, 1, 0, 99.0, 500), (2, 0, 0, 10.0, 10), (2, 1, 0, 99.0, 500)], "p int, s int, a int, conf double, length int")
    assert {r.p: r.s for r in layout.best_strategy(df, "p", "s", "a").collect()} == {1: 0, 2: 1}


def test_recognised_words_skip_short_lines(spark):
    tsv = "block_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext\n1\t1\t1\t5\t6\t7\t8\t91.7\tword\nbad\tline\n1\t1\t1\t5\t6\t7\t8\t-1\t"
    df = spark.createDataFrame([(1, tsv)], "id int, tsv string")
    assert [(r.x, r.conf, r.text) for r in readers.recognised_words(df, "id", "tsv").orderBy("ord").collect()] == [(5, 91, "word"), (5, -1, "")]


def test_labelled_corpus(spark, tmp_path):
    (tmp_path / "t.csv").write_text('filename,label,text,table_row_count,table_text_ratio,avg_cells_per_row\na, Case List ,"two\nlines",,0.5,\n')
    row = readers.labelled_corpus(spark, str(tmp_path / "t.csv")).first()
    assert (row.label, row.text, row.table_row_count, row.table_text_ratio) == ("Case List", "two\nlines", 0, 0.5)


def test_replaced_jobs(spark, tmp_path):
    path = str(tmp_path / "frames")
    writers.append(spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, v int"), path)
    writers.replace_jobs(spark.createDataFrame([("a", 9)], "job_id string, v int"), path)
    assert sorted((r.job_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_logistic_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [("income wages salary pay", "A"), ("household family children spouse", "B")] * 8
    df = spark.createDataFrame(rows, "text string, label string")
    path = str(tmp_path / "model")
    classify.train_logistic(df, "label", "text").write().overwrite().save(path)
    got = PipelineModel.load(path).transform(df)
    assert got.filter("prediction = _label").count() == len(rows)


def test_linear_svm_and_cross_validation(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, t, label) for i, (t, label) in enumerate([("income wages salary pay", "A"), ("household family children spouse", "B"), ("policy rule guidance criteria", "C")] * 10)]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    path = str(tmp_path / "svm")
    classify.train_linear_svm(df, "label", "text").write().overwrite().save(path)
    assert classify.predicted_label(PipelineModel.load(path), df).filter("predicted = label").count() == len(rows)
    done = classify.cross_validated(df, "label", "id", "text", k=3)
    assert done.count() == len(rows) and classify.fold_summary(done, "fold", "label", "predicted").first().asDict() == {"folds": 3, "mean": 1.0, "std": 0.0, "min": 1.0, "max": 1.0}


def test_one_failing_row_ends_nothing(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None), (4, "0")], "id bigint, t string")
    done = batch.batch_map(df, "id", ["t"], lambda t: 8 // int(t), "int")
    got = {r.id: (r.result, (r.error or "").split(":")[0]) for r in done.collect()}
    assert got == {1: (2, ""), 2: (None, "ValueError"), 3: (None, "TypeError"), 4: (None, "ZeroDivisionError")}
    assert tuple(batch.batch_counts(done).first()) == (1, 3)
    assert batch.batch_map(df.limit(0), "id", ["t"], lambda t: 1, "int").collect() == []


def test_results_by_job_and_frame(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], i // 2) for i in range(12)], "id bigint, job_id string, frame_id string, created_at bigint")
    ids = lambda **k: [r.id for r in lookups.results(df, **k).collect()]
    assert ids(limit=3) == [11, 10, 9] and ids(job_id="a") == [10, 8, 6, 4, 2, 0] and ids(frame_id="x") == [9, 6, 3, 0] and ids(job_id="a", frame_id="x") == [6, 0]


def test_a_threshold_of_zero_shows_all(spark):
    df = spark.createDataFrame([("j", 10.0), ("j", 60.0), ("j", None)], "job string, c double")
    assert tuple(lookups.shown_of_total(df, "job", "c", 0).first()) == ("j", 3, 3) and tuple(lookups.shown_of_total(df, "job", "c", 50).first()) == ("j", 1, 3)


DECODER = """
class Clip:
    codec, width, height = "raw", 2, 2

    def __init__(self, path):
        data = open(path.removeprefix("file:"), "rb").read()
        if data[:4] != b"CLIP":
            raise ValueError("not a clip")
        self.data, self.fps = data[5:], data[4] * 4
        self.frame_count, self.end_ms = len(self.data) // 4, 123.0

    def frames(self):
        for i in range(self.frame_count):
            yield i * 1000 / self.fps, self.data[4 * i : 4 * i + 4]


def opened(path):
    return Clip(path)
"""


def test_recordings_by_a_plugged_decoder(spark, tmp_path):
    (tmp_path / "clip_decoder.py").write_text(DECODER)
    spark.sparkContext.addPyFile(str(tmp_path / "clip_decoder.py"))
    folder = tmp_path / "clips"
    folder.mkdir()
    (folder / "a.mp4").write_bytes(b"CLIP\x01" + bytes(range(12)))
    (folder / "b.webm").write_bytes(b"CLIP\xff" + bytes(8))  # a rate of over 500 can't be: the last position counts
    (folder / "c.mov").write_bytes(b"junk")
    (folder / "d.txt").write_bytes(b"CLIP\x01")
    got = {r.path.rsplit("/", 1)[1]: r for r in video.probe(spark, str(folder), "clip_decoder:opened").collect()}
    assert (got["a.mp4"].valid, got["a.mp4"].duration_ms, got["a.mp4"].width, got["a.mp4"].codec) == (True, 750.0, 2, "raw")
    assert got["b.webm"].duration_ms == 123.0 and got["c.mov"].error == "ValueError: not a clip"
    assert got["d.txt"].error == "unsupported extension: txt" and not got["d.txt"].valid
    rows = video.frames(spark, [str(folder / "a.mp4"), str(folder / "b.webm")], "clip_decoder:opened").collect()
    assert sorted((r.path[-6:], r.frame_index, r.timestamp_ms, bytes(r.pixels)) for r in rows if r.path.endswith("a.mp4")) == [("/a.mp4", i, i * 250, bytes(range(4 * i, 4 * i + 4))) for i in range(3)]
    assert len(rows) == 5


def test_failing_taggers_have_error_rows(spark):
    def names(texts):
        if "bad" in texts[0]:
            raise RuntimeError("model failed")
        return [[(0, 3, "NAME")]]

    df = spark.createDataFrame([(1, "Ana wrote"), (2, "bad text"), (3, None)], "id bigint, t string")
    got = {r.key: (r.text, r.label, r.error) for r in plugins.tagged(df, "id", "t", names).collect()}
    assert got == {1: ("Ana", "NAME", None), 2: (None, None, "model failed"), 3: ("", "NAME", None)} and plugins.tagged(df, "id", "t", None).collect() == []


def test_word_lists():
    assert len(rules.RELEVANCE_KEYWORDS) == 21 and len(rules.ENTITY_TYPES) == 22 and len(rules.STATE_NAMES) == 51


def test_entities_beside_marks_of_their_own(spark):
    """Signs that the matcher puts around matches may be in a text; positions and texts are those of the text as it is."""
    texts = ["﷐Write to a.b@c.org﷑ by 01/02/2020, pay 5%﷒", "NPI: 1234567890 of John Smith in New York", "no trigger here", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = entities.entity_rows(df, ["id"], "text").collect()
    assert [(r.id, r.type, r.text) for r in sorted(rows, key=lambda r: (r.id, r.start))] == [
        (0, "email", "a.b@c.org"), (0, "date", "01/02/2020"), (0, "percentage", "5%"), (1, "npi", "1234567890"), (1, "person_name", "John Smith"), (1, "state", "New York")]
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.text


def test_triggers_let_every_match_through(spark):
    """A text of each built-in pattern passes the trigger of its type."""
    samples = [
        "EIN 12-3456789", "tax id: 12-3456789", "tin 12-3456789", "Employer ID 12-3456789", "clm: ABCDE1", "prior auth abcde12", "transaction # ABCDE", "grp # AB12", "Enrollee ID AB12", "plan no. xyz9",
        "pol-123", "cert # 123-4", "contract # 123", "docket # 12", "REF # 12-3", "incident no. A12", "acct 1234567", "a/c 1234567", "ABA 123456789", "iban DE12ABCD", "npi 1234567890", "National Provider ID 1234567890",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "id int, text string")
    found = {r.id for r in entities.entity_rows(df, ["id"], "text").collect()}
    assert found == set(range(len(samples)))


def test_unique_content_of_large_jobs_in_chunks(spark):
    """A word in every frame, copies, empty and missing texts: chunks and the join on words both equal all pairs."""
    random.seed(5)
    rows = [("big", i, "common " + " ".join(random.choice("abcdefghij") * 3 + random.choice("xyz") for _ in range(random.randint(0, 6)))) for i in range(60)]
    rows += [("big", 60 + i, "common aaax bbby") for i in range(25)] + [("big", 90, ""), ("big", 91, None), ("big", 92, "no")]
    rows += [("small", i, t) for i, t in enumerate(["one two three", "two three four", "two three four", "other"])] + [("single", 0, "alone here")]
    words = {(j, f): {w for w in re.split(r"\s+", (t or "").lower()) if len(w) > 2} for j, f, t in rows}
    due = {}
    for (j, f), mine in words.items():
        others = [w for (k, g), w in words.items() if k == j and g != f and w]
        due[j, f] = (1 - (sum(len(mine & w) / len(mine | w) for w in others) / len(others) if others else 0)) * len(mine) if mine else 0
    df = spark.createDataFrame(rows, "job string, frame int, text string")
    for sets, most in ((8, 50_000), (512, 40), (512, 50_000)):
        got = {(r.job, r.frame): r.unique_content for r in search.unique_content(df, "job", "frame", "text", sets, most).collect()}
        assert got.keys() == due.keys()
        assert all(abs(got[k] - due[k]) < 1e-9 for k in due)
