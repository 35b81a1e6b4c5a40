"""Queries of text classification and of word and box layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import shapes
from quillframe.functions.text import normalise_for_model
from quillframe.operators import classify as C
from quillframe.operators import layout as L
from quillframe.operators import learn
from quillframe.operators import scoring as S
from quillframe.operators import spelling
from quillframe.operators import structure as X
from quillframe.operators.batch import batch_counts, batch_map
from quillframe.shipping import ship

from .registry import FRAMES, frames, query, table

_STOP = "(" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + ")"

TF_IDF = f"""n as (select count(*) as n from documents),
    w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) as word from documents),
    c as (select doc_id, word, count(*) as tf from w where word not in {_STOP} group by all),
    v as (select word, count(*) as df from c group by word having count(*) >= 2 order by sum(tf) desc, word limit 500),
    r as (select doc_id, word, tf, df, tf * (ln((1.0 + n) / (1 + df)) + 1) as raw from c join v using (word), n),
    u as (select doc_id, word, tf, df, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from r)"""


@query("""select doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' 555-010-2000 1/2/1999 1999-01-02', '[^\\x20-\\x7E]+', ' ', 'g'), ' {2,}', ' ', 'g'),
    '\\(?\\b[0-9]{3}\\)?[ .\\-][0-9]{3}[ .\\-][0-9]{4}\\b', 'PHONE_NO', 'g'), '\\b[0-9]{1,2}[/\\-][0-9]{1,2}[/\\-][0-9]{2,4}\\b', 'DATE_VAL', 'g'), '\\b[0-9]{4}[/\\-][0-9]{1,2}[/\\-][0-9]{1,2}\\b', 'DATE_VAL', 'g'))) as text from documents""")
def m1_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalise_for_model(F.concat("text", F.lit(" 555-010-2000 1/2/1999 1999-01-02"))).alias("text"))


# The dictionary: words of letters that occur often; texts are those of conversations, so that some words are unknown. DuckDB measures bytes, so signs beyond ASCII are shown as x.
_KNOWN = """dict as (select word, count(*) as n from (select unnest(string_split_regex(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '[^\\p{L}]+')) as word from documents) where word <> '' group by word having count(*) >= 12)"""


@query(f"""with {_KNOWN}, shown as (select conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') as text from conversations),
    parts as (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as part, generate_subscripts(string_split_regex(text, '\\s+'), 1) as at_ from shown),
    bare as (select conv_id, turn, at_, trim(part, '.,*!?;:"''()-') as bare from parts), marked as (select *, case when regexp_matches(bare, '^\\p{{L}}+$') and upper(bare) <> bare then lower(bare) end as word from bare where bare <> ''),
    unknown as (select distinct word from marked where word is not null and word not in (select word from dict)),
    near as (select u.word, d.word as known, d.n, damerau_levenshtein(u.word, d.word) as far from unknown u join dict d on length(d.word) between length(u.word) - 2 and length(u.word) + 2),
    best as (select word, known as correction from near where far <= 2 qualify row_number() over (partition by word order by far, n desc, known) = 1)
    select conv_id, turn, string_agg(coalesce(correction, m.word, bare), ' ' order by at_) as corrected from marked m left join best using (word) group by conv_id, turn""")
def m1_corrected(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda name: table(spark, d, name).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    words = spelling.word_counts(shown("documents"), "text", 12)
    return spelling.corrected(shown("conversations"), "text", words).filter("corrected != ''").select("conv_id", "turn", "corrected")


# Tables of a document: its pipe-separated lines.
@query("""with l as (select doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, '|')) as rows from documents),
    c as (select doc_id, len(rows) as n_rows, list_sum(list_transform(rows, lambda r: len(string_split(r, '|')))) as cells, list_sum(list_transform(rows, lambda r: list_sum(list_transform(string_split(r, '|'), lambda x: case when trim(x) = '' then 0 else len(string_split_regex(trim(x), '\\s+')) end)))) as words,
        len(regexp_extract_all(coalesce(text, ''), '[a-z]+')) as n from l)
    select doc_id, n_rows as table_row_count, round(case when n + coalesce(words, 0) > 0 then coalesce(words, 0) / (n + coalesce(words, 0)) else 0 end, 6) as table_text_ratio, round(case when n_rows > 0 then cells / n_rows else 0 end, 6) as avg_cells_per_row from c""")
def m2_document_features(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.contains(x, F.lit("|")))
    tables = F.array(F.transform(lines, lambda x: F.split(x, r"\|", -1)))
    f = C.document_features(tables, F.size(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))))
    return t.select("doc_id", F.col("doc_id").alias("k"), *[v.alias(k) for k, v in f.items()]).select("doc_id", F.col("table_row_count").cast("long").alias("table_row_count"), F.round("table_text_ratio", 6).alias("table_text_ratio"), F.round("avg_cells_per_row", 6).alias("avg_cells_per_row"))


@query(f"with {TF_IDF} select doc_id, word, tf, df, round(weight, 6) as weight from u")
def m3_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    return C.tf_idf(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "word", "tf", "df", F.round("weight", 6).alias("weight"))


@query(f"with {TF_IDF} select doc_id, count(*) as words, round(max(weight), 6) as best from (select *, row_number() over (partition by doc_id order by weight desc, word) as r from u where weight > 0) where r <= 20 group by doc_id")
def m3_top_words(spark: SparkSession, d: str) -> DataFrame:
    top = C.top_words(C.tf_idf(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return top.groupBy("doc_id").agg(F.count("*").alias("words"), F.round(F.max("weight"), 6).alias("best"))


#: Fitted on two thirds of the documents, applied to the others.
_FITTED = f"""n as (select count(*) as n from documents where doc_id % 3 <> 0), w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) as word from documents), c as (select doc_id, word, count(*) as tf from w where word not in {_STOP} group by all),
    v as (select word, count(*) as df from c where doc_id % 3 <> 0 group by word having count(*) >= 2 order by sum(tf) desc, word limit 500), r as (select doc_id, word, tf, df, tf * (ln((1.0 + n) / (1 + df)) + 1) as raw from c join v using (word), n where doc_id % 3 = 0),
    u as (select doc_id, word, tf, df, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from r)"""


@query(f"""with {_FITTED}, k as (select doc_id, count(*) as vocab_size, max(weight) as best from u group by doc_id), p as (select word, row_number() over (order by word) - 1 as position from v)
    select d.doc_id, coalesce(vocab_size, 0) as vocab_size, round(best, 6) as best_weight, round((select sum(weight * position) from u join p using (word) where u.doc_id = d.doc_id), 4) as moment from documents d left join k on k.doc_id = d.doc_id where d.doc_id % 3 = 0""")
def m3_fitted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = learn.TfIdf.fit(docs.filter("doc_id % 3 <> 0"), "doc_id", "text")
    told = model.summaries(docs.filter("doc_id % 3 = 0"), "doc_id", "text")
    moment = F.aggregate(F.transform("vector", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return told.select("doc_id", F.col("vocab_size").cast("long").alias("vocab_size"), F.round(F.get("keywords", F.lit(0))["weight"], 6).alias("best_weight"), F.when(F.col("vocab_size") > 0, F.round(moment, 4)).alias("moment"))


@query()
def m5_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the labelled documents by support-vector machines with probabilities, each fold by the others, with a reject option."""
    known = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    told = learn.calibrated_predictions(known, "quality", "doc_id", "text").withColumn("r", C.with_reject(F.col("probabilities")))
    return told.select("doc_id", "fold", "quality", F.col("r.label").alias("predicted"), F.col("r.confidence").alias("confidence"))


@query(f"""with {FRAMES}, p as (select event_id, unnest(['a', 'b', 'c']) as label, unnest([k / 100.0, (100 - k) / 200.0, (100 - k) / 200.0]) as p from frames),
    b as (select * from p qualify row_number() over (partition by event_id order by p desc, label) = 1) select event_id, case when p >= 0.6 then label else 'Unknown' end as label, p as confidence from b""")
def m4_reject(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    m = F.create_map(F.lit("a"), k / 100.0, F.lit("b"), (100 - k) / 200.0, F.lit("c"), (100 - k) / 200.0)
    return frames(spark, d).select("event_id", C.with_reject(m).alias("r")).select("event_id", "r.label", "r.confidence")


@query("""with f as (select label, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i, vec_id % 3 + 1 as w from embeddings),
    m as (select label, i, sum(v * w) / sum(w) as v from f group by all) select label, i - 1 as dimension, round(v / (sqrt(sum(v * v) over (partition by label)) + 1e-10), 6) as value from m""")
def m7_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 + 1).alias("w"))
    m = C.mean_vector(e, "label", "v", "w").select("label", F.posexplode("unit").alias("dimension", "value"))
    return m.select("label", F.col("dimension").cast("long").alias("dimension"), F.round("value", 6).alias("value"))


@query("""with l as (select quality, count(*) as n from labels group by quality) select quality, f.fold, n // 5 + case when f.fold < n % 5 then 1 else 0 end as n from l, (values (0), (1), (2), (3), (4)) f(fold)""")
def m9_fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.folds(table(spark, d, "labels"), "quality", "doc_id").groupBy("quality", "fold").agg(F.count("*").alias("n"))


PREDICTED = "case when n_chars % 7 = 0 then 'Unknown' when n_chars > 1500 then '1' else '0' end"


def _predicted(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    n = F.col("n_chars")
    guess = F.when(n % 7 == 0, "Unknown").when(n > 1500, "1").otherwise("0")
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("string").alias("truth"), guess.alias("predicted"), *more)


@query(f"""with p as (select cast(quality as varchar) as truth, {PREDICTED} as predicted from labels join documents using (doc_id))
    select count(*) as n, round(count(*) filter (truth = predicted) / count(*), 6) as accuracy, count(*) filter (predicted = 'Unknown') as unknown, round(count(*) filter (predicted = 'Unknown') / count(*), 6) as unknown_rate,
        round(count(*) filter (truth = predicted) / count(*) filter (predicted <> 'Unknown'), 6) as committed_accuracy from p""")
def m10_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = C.metrics(_predicted(spark, d), "truth", "predicted")
    return m.select("n", "unknown", *[F.round(c, 6).alias(c) for c in ("accuracy", "unknown_rate", "committed_accuracy")])


@query(f"""with p as (select doc_id % 5 as fold, cast(quality as varchar) as truth, {PREDICTED} as predicted from labels join documents using (doc_id)),
    a as (select fold, count(*) filter (truth = predicted) / count(*) as accuracy from p group by fold)
    select count(*) as folds, round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std, round(min(accuracy), 6) as min, round(max(accuracy), 6) as max from a""")
def m9_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    got = C.fold_summary(_predicted(spark, d, (F.col("doc_id") % 5).alias("fold")), "fold", "truth", "predicted")
    return got.select("folds", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


@query("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as word from documents), v as (select word from t where doc_id % 4 <> 0 group by word having count(*) >= 3),
    r as (select doc_id, 1 - count(v.word) / count(*) as rate from t left join v using (word) group by doc_id) select count(*) as rows, round(avg(rate), 6) as oov_rate from r""")
def m10_oov_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    seen = docs.filter("doc_id % 4 <> 0").select(F.explode(C.tokens(F.col("text"), [])).alias("word")).groupBy("word").count().filter("count >= 3")
    got = C.oov_rate(docs, "doc_id", "text", seen)
    return got.select("rows", F.round("oov_rate", 6).alias("oov_rate"))


def _rule_label(text: str | None, n_chars: int) -> tuple[str, float]:
    if n_chars % 7 == 0:
        raise ValueError("image not found")
    return ("long" if len(text or "") > 1000 else "short"), n_chars % 10 / 10


@query("""select doc_id, case when n_chars % 7 = 0 then null when length(coalesce(text, '')) > 1000 then 'long' else 'short' end as label, case when n_chars % 7 <> 0 then n_chars % 10 / 10 end as confidence,
    case when n_chars % 7 = 0 then 'ValueError: image not found' end as error from documents""")
def m13_batch_classified(spark: SparkSession, d: str) -> DataFrame:
    done = batch_map(table(spark, d, "documents"), "doc_id", ["text", "n_chars"], _rule_label, "struct<label:string,confidence:double>")
    return done.select("doc_id", "result.label", "result.confidence", "error")


@query("select count(*) filter (n_chars % 7 <> 0) as done, count(*) filter (n_chars % 7 = 0) as errors from documents")
def o16_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return batch_counts(batch_map(table(spark, d, "documents"), "doc_id", ["text", "n_chars"], _rule_label, "struct<label:string,confidence:double>"))


@query(f"""with p as (select cast(quality as varchar) as truth, {PREDICTED} as predicted from labels join documents using (doc_id)), l as (select truth as label from p union select predicted from p),
    c as (select label, (select count(*) from p where truth = label) as support, (select count(*) from p where predicted = label) as claimed, (select count(*) from p where truth = label and predicted = label) as hits from l),
    r as (select label, support, coalesce(hits / nullif(claimed, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall from c)
    select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from r""")
def m10_class_report(spark: SparkSession, d: str) -> DataFrame:
    r = C.class_report(_predicted(spark, d), "truth", "predicted")
    return r.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("select event_id, case when event_id % 3 = 0 then 'State Eligibility' when event_id % 3 = 1 then 'Case List' else event_type end as label from events")
def m11_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 3
    return table(spark, d, "events").select("event_id", C.normal_label(F.when(n == 0, "state ELIGIBILITY determination").when(n == 1, " Case List ").otherwise(F.col("event_type"))).alias("label"))


@query("""with t as (select event_id, event_type as lr, case event_id % 5 when 0 then '' when 1 then 'unavailable' when 2 then 'Unknown' when 3 then 'Case List' end as svm from events)
    select event_id, case when svm is null or svm in ('', 'unavailable') then lr else svm end as stored, case when svm is null or svm in ('', 'unavailable', 'Unknown') then lr else svm end as shown from t""")
def m12_consensus(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 5
    svm = F.when(n == 0, "").when(n == 1, "unavailable").when(n == 2, "Unknown").when(n == 3, "Case List")
    return table(spark, d, "events").select("event_id", C.consensus(svm, F.col("event_type")).alias("stored"), C.consensus(svm, F.col("event_type"), True).alias("shown"))


WORDS = """w as (select user_id as page, event_id as ord, cast(event_id % 3 as int) as block, cast(event_id % 2 as int) as par, cast(event_id // 50 % 4 as int) as line, case when event_id % 11 = 0 then ' ' else event_type end as text, cast(floor(value) as int) as conf from events)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("page"), n.alias("ord"), (n % 3).cast("int").alias("block"), (n % 2).cast("int").alias("par"), (F.floor(n / 50) % 4).cast("int").alias("line"), F.when(n % 11 == 0, " ").otherwise(F.col("event_type")).alias("text"), F.floor("value").cast("int").alias("conf"))


@query(f"with {WORDS} select page, md5(string_agg(text, ' ' order by ord)) as text, count(*) as n_words, round(avg(conf), 6) as mean_conf from w where conf >= 30 and trim(text) <> '' group by page")
def o1_page_text(spark: SparkSession, d: str) -> DataFrame:
    return L.page_text(_words(spark, d), "page", "ord").select("page", F.md5("text").alias("text"), "n_words", F.round("mean_conf", 6).alias("mean_conf"))


@query(f"""with {WORDS}, g as (select * from w where conf >= 20 and trim(text) <> ''), l as (select page, block, par, line, string_agg(text, ' ' order by ord) as text from g group by all),
    p as (select page, block, par, string_agg(text, chr(10) order by line) as text from l group by all), t as (select page, string_agg(text, chr(10) || chr(10) order by block, par) as text from p group by page)
    select t.page, md5(t.text) as text, round(c.conf, 6) as mean_conf from t left join (select page, avg(conf) as conf from g where conf >= 30 group by page) c using (page)""")
def o2_page_layout(spark: SparkSession, d: str) -> DataFrame:
    return L.page_layout(_words(spark, d), "page", "ord").select("page", F.md5("text").alias("text"), F.round("mean_conf", 6).alias("mean_conf"))


# Every eight frames of a job are the attempts of one page, two per strategy; the best so far decides after each strategy whether another is run.
@query(f"""with recursive {FRAMES}, a as (select job_id * 1000000 + frame_index // 8 as page, frame_index % 8 // 2 as strategy, frame_index % 2 as attempt, least(k, 80)::double as conf, (k * 13) % 700 as length from frames),
    s as (select *, 0.7 * conf + 30 * least(length / 500.0, 1.0) as score from a),
    best as (select x.page, x.strategy, y.conf from (select distinct page, strategy from s) x join s y on y.page = x.page and y.strategy <= x.strategy qualify row_number() over (partition by x.page, x.strategy order by y.score desc, y.strategy, y.attempt) = 1),
    stop as (select page, min(strategy) filter (conf >= 75) as stop from best group by page)
    select s.page, s.strategy, s.attempt, round(s.score, 6) as score from s join stop using (page) where stop is null or strategy <= stop qualify row_number() over (partition by s.page order by s.score desc, strategy, attempt) = 1""")
def o3_best_strategy(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("frame_index"), F.col("k")
    page = F.col("job_id") * 1_000_000 + F.floor(i / 8).cast("long")
    a = frames(spark, d).select(page.alias("page"), F.floor(i % 8 / 2).cast("long").alias("strategy"), (i % 2).alias("attempt"), F.least("k", F.lit(80)).cast("double").alias("conf"), (k * 13 % 700).alias("length"))
    return L.best_strategy(a, "page", "strategy", "attempt").select("page", "strategy", "attempt", F.round("score", 6).alias("score"))


BOXES = "b as (select cast(event_id % 100 as int) as image, cast(event_id as int) as ord, cast((event_id * 37) % 600 as int) as x, cast((event_id * 61) % 400 as int) as y, cast(40 + event_id % 90 as int) as w, cast(20 + event_id % 70 as int) as h, value as score from events)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    made = {"image": n % 100, "ord": n, "x": n * 37 % 600, "y": n * 61 % 400, "w": 40 + n % 90, "h": 20 + n % 70}
    return table(spark, d, "events").select(*[v.cast("int").alias(k) for k, v in made.items()], F.col("value").alias("score"))


def _fold_sql(order: str, limit: str) -> str:
    shared = "greatest(0, least(r.x + r.w, k.x + k.w) - greatest(r.x, k.x)) * greatest(0, least(r.y + r.h, k.y + k.h) - greatest(r.y, k.y))"
    return f"""with recursive {BOXES}, r as (select *, row_number() over (partition by image order by {order}, ord) as n from b),
        f(image, n, kept) as (select image, 0::bigint, []::struct(x int, y int, w int, h int, ord int)[] from r group by image union all
            select r.image, r.n, case when len(list_filter(f.kept, lambda k: {shared} >= {limit})) > 0 then f.kept else list_append(f.kept, {{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'ord': r.ord}}) end
            from f join r on r.image = f.image and r.n = f.n + 1)
        select image, unnest(kept).ord as ord from f qualify n = max(n) over (partition by image)"""


@query(_fold_sql("w * h desc", "0.3 * (r.w * r.h)"))
def o5_merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    return L.merge_boxes(_boxes(spark, d), "image").select("image", "ord")


@query(f"with {BOXES} select image, ord from b where w * h / (640 * 480.0) between 0.001 and 0.8 and w > 20 and h > 10")
def o7_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.candidate_boxes(_boxes(spark, d), F.lit(640), F.lit(480)).select("image", "ord")


@query(f"""with {BOXES}, g as (select *, y - (lag(y) over (partition by image order by y, ord) + lag(h) over (partition by image order by y, ord)) as gap from (select image, ord, x, cast(ord // 100 * 25 as int) as y, w * 3 as w, h // 4 as h from b) where w > 96 and h > 8 and h < 60),
    i as (select *, sum(case when gap >= 0 and gap < 40 then 0 else 1 end) over (partition by image order by y, ord) as grp from g),
    t as (select image, count(*) as n, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from i group by image, grp)
    select image, n, x, y, w, h from t where n >= 3 and w > 100 and h > 60""")
def o9_borderless_tables(spark: SparkSession, d: str) -> DataFrame:
    lines = _boxes(spark, d).withColumns({"y": F.floor(F.col("ord") / 100).cast("int") * 25, "w": F.col("w") * 3, "h": F.floor(F.col("h") / 4).cast("int")})
    return L.borderless_tables(lines, "image", F.lit(640))


@query(f"with {BOXES} select image, ord, case when score / 100 > 0.75 then 'radio' else 'checkbox' end as kind, score % 1 > 0.4 as checked from b where w between 10 and 50 and h between 10 and 50 and w / h between 0.7 and 1.4")
def o10_marks(spark: SparkSession, d: str) -> DataFrame:
    shapes = _boxes(spark, d).withColumns({"extent": F.lit(0.9), "circularity": F.col("score") / 100, "fill": F.col("score") % 1})
    return L.mark_kind(shapes).select("image", "ord", "kind", "checked")


@query(f"""with {BOXES}, f as (select image, ord, case when h > 50 then 'textarea' when score * 3 > 200 and ord % 60 < 30 then 'text_input' when score * 3 > 150 then 'filled' end as kind from b where w >= 50 and h between 15 and 80 and w * h / (640 * 480.0) between 0.001 and 0.15 and w / h >= 2 and ord % 8 between 4 and 6)
    select * from f where kind is not null""")
def o11_fields(spark: SparkSession, d: str) -> DataFrame:
    shapes = _boxes(spark, d).withColumns({"vertices": F.col("ord") % 8, "mean": F.col("score") * 3, "std": (F.col("ord") % 60).cast("double")})
    return L.field_kind(shapes, F.lit(640), F.lit(480)).select("image", "ord", "kind")


@query(f"""with {FRAMES}, p as (select job_id, frame_index as at_, k from frames where k > 40), g as (select *, sum(case when at_ - b = 1 then 0 else 1 end) over (partition by job_id order by at_) as run from (select *, lag(at_) over (partition by job_id order by at_) as b from p))
    select job_id, (min(at_) + max(at_)) // 2 as mid from g group by job_id, run""")
def o12_line_positions(spark: SparkSession, d: str) -> DataFrame:
    return L.line_positions(frames(spark, d).select("job_id", "frame_index", "k"), "job_id", "frame_index", "k", 40)


# Lines of a user's first forty events: their values across, their kinds' numbers down.
_LINES_AT = """e as (select user_id as t, value, cast(json_extract_string(props, '$.k') as int) as k, row_number() over (partition by user_id order by event_id) as n from events),
    rows as (select distinct t, cast(floor(value) as int) * 3 as mid from e where n <= 40), cols as (select distinct t, k * 7 as mid from e where n <= 40 and k is not null)"""


@query(f"""with {_LINES_AT}, r as (select t, mid as a, lead(mid) over (partition by t order by mid) as b, row_number() over (partition by t order by mid) - 1 as n from rows), c as (select t, mid as a, lead(mid) over (partition by t order by mid) as b, row_number() over (partition by t order by mid) - 1 as n from cols)
    select r.t as t, r.n as row, c.n as col, c.a as x1, r.a as y1, c.b as x2, r.b as y2 from r join c using (t) where r.b - r.a >= 10 and c.b - c.a >= 10""")
def o12_cell_grid(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").withColumn("n", nth).filter("n <= 40").select(F.col("user_id").alias("t"), (F.floor("value").cast("int") * 3).alias("across"), (F.get_json_object("props", "$.k").cast("int") * 7).alias("down"))
    lines, columns = e.select("t", F.col("across").alias("mid")).distinct(), e.filter("down is not null").select("t", F.col("down").alias("mid")).distinct()
    grid = L.cell_grid(lines, columns, "t")
    return grid.select("t", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""with c as (select cast(event_id // 12 as int) as t, cast(event_id % 12 // 4 as int) as row, cast(event_id % 4 as int) as col, event_type as text from events where event_id % 5 <> 0),
    s as (select t, max(row) as r, max(col) as c from c group by t), g as (select s.t, i.i, j.j, coalesce(any_value(c.text), '') as text from s, range(3) i(i), range(4) j(j) left join c on c.t = s.t and c.row = i.i and c.col = j.j where i.i <= s.r and j.j <= s.c group by all),
    l as (select t, i, string_agg(text, chr(9) order by j) as line from g group by all) select t, cast(count(*) as int) as num_rows, md5(string_agg(line, chr(10) order by i)) as raw_text from l group by t""")
def o13_dense_tables(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    cells = table(spark, d, "events").filter("event_id % 5 != 0").select(F.floor(n / 12).cast("int").alias("t"), F.floor(n % 12 / 4).cast("int").alias("row"), (n % 4).cast("int").alias("col"), F.col("event_type").alias("text"))
    return L.dense_table(cells, "t").select("t", "num_rows", F.md5("raw_text").alias("raw_text"))


@query(_fold_sql("score desc", "0.8 * least(r.w * r.h, k.w * k.h)"))
def o15_suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    return L.suppress(_boxes(spark, d), "image").select("image", "ord")


@query(f"""with {FRAMES}, s as (select job_id, event_id, k % 10 as sig, row_number() over (partition by job_id, k % 10 order by event_id) as r from frames), n as (select *, row_number() over (partition by job_id order by event_id) as n from s where r = 1)
    select job_id, event_id from n where n <= 3""")
def o17_distinct_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array((F.col("k") % 10).cast("string")))
    return X.distinct_tables(frames(spark, d).withColumn("rows", rows), "job_id", "event_id", "rows").select("job_id", "event_id")


@query("""with t as (select avg(n_chars) as m, stddev_pop(n_chars) as s from documents where doc_id % 5 <> 0) select doc_id, round((n_chars - m) / s, 6) as n_chars from documents, t""")
def m8_scaled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    got = C.scale(t, C.fit_scale(t.filter("doc_id % 5 != 0"), ["n_chars"]), ["n_chars"])
    return got.select("doc_id", F.round("n_chars", 6).alias("n_chars"))


@query(f"""with {BOXES}, f as (select image, ord, w * 4 / greatest(h, 1) as aspect, w * 4 * h / (640 * 480.0) as share, y / 480 as top, h, ord % 90 as std, score % 1 as edges, score / 200 as density, ord % 9 as across, ord % 7 as down from b)
    select image, ord, case when aspect > 5 and top < 0.15 and share > 0.02 then 'navbar' when aspect > 5 and top > 0.85 then 'footer'
        when aspect > 1.5 and aspect < 8 and share < 0.02 and h > 20 and h < 80 and std < 50 then 'button' when aspect > 3 and h > 20 and h < 60 and share < 0.03 and edges > 0.05 then 'input_field'
        when share > 0.03 and density < 0.1 then 'image' when across + down > 6 and across > 2 and down > 2 then 'table' else 'text_block' end as kind from f""")
def o6_elements(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumns({"w": F.col("w") * 4, "std": F.col("ord") % 90, "edges": F.col("score") % 1, "density": F.col("score") / 200, "across": F.col("ord") % 9, "down": F.col("ord") % 7})
    return b.select("image", "ord", L.element_kind(F.lit(640), F.lit(480)).alias("kind"))


@query(f"with {BOXES} select image, ord from b where w * h >= 0.005 * 640 * 480 and w >= 60 and h >= 40 and (score * 3) / (w * h) > 0.005 and (ord % 40) / (w * h) > 0.005")
def o8_bordered_regions(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumns({"across": F.col("score") * 3, "down": F.col("ord") % 40})
    return L.bordered_regions(b, F.lit(640), F.lit(480)).select("image", "ord")


# Vectors as 8 x 8 grey images, each pixel drawn 8 x 8 wide: what is dark by Otsu's level, labelled by reaching from pixel to pixel.
_PIXELS = """g as (select vec_id, list_transform(embedding[1:64], lambda x: cast(floor(abs(x::double) * 1000) as int) % 256) as p from embeddings),
    px as (select vec_id, y, x, p[8 * y + x + 1] as v from g, range(8) a(y), range(8) b(x)),
    levels as (select l.vec_id, l.v as level, count(*) filter (px.v <= l.v) as n, coalesce(sum(px.v) filter (px.v <= l.v), 0) as s, sum(px.v) as total from (select distinct vec_id, v from px) l join px using (vec_id) group by all),
    cut as (select vec_id, arg_max(level, (apart, -level)) as level from (select vec_id, level, case when n < 64 then n * (64 - n) * power(s / n - (total - s) / (64 - n), 2) else 0 end as apart from levels) group by vec_id),
    dark as (select vec_id, y, x, 8 * y + x as id, v from px join cut using (vec_id) where v <= level),
    reach(vec_id, root, y, x) as (select vec_id, id, y, x from dark union
        select r.vec_id, r.root, d.y, d.x from reach r join dark d on d.vec_id = r.vec_id and abs(d.y - r.y) <= 1 and abs(d.x - r.x) <= 1),
    parts as (select vec_id, y, x, min(root) as part from reach group by all),
    boxes as (select vec_id, part, 8 * min(x) as x, 8 * min(y) as y, 8 * (max(x) - min(x) + 1) as w, 8 * (max(y) - min(y) + 1) as h, 64 * count(*) as area from parts group by vec_id, part)"""


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform(F.slice("embedding", 1, 64), lambda v: F.lpad(F.hex(F.floor(F.abs(v.cast("double")) * 1000).cast("int") % 256), 2, "0"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.transform(F.slice(values, y * 8 + 1, F.lit(8)), lambda v: F.repeat(v, F.lit(8))), ""), F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", F.lit(64).alias("height"), F.lit(64).alias("width"), F.unhex(F.array_join(rows, "")).alias("pixels"))


@query(f"with recursive {_PIXELS} select vec_id, x, y, w, h, area from boxes")
def o7_components(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    found = _drawn(spark, d).select("vec_id", F.explode(shapes.shape_udf(shapes.dark_components)("height", "width", "pixels")).alias("b"))
    return found.select("vec_id", "b.x", "b.y", "b.w", "b.h", "b.area")


@query(f"""with recursive {_PIXELS}, good as (select *, row_number() over (partition by vec_id order by w * h desc, part) as n from boxes where w between 10 and 50 and h between 10 and 50 and w / h between 0.7 and 1.4),
    kept(vec_id, n, xs) as (select vec_id, 0::bigint, []::struct(x bigint, y bigint, w bigint, h bigint)[] from good group by vec_id union all
        select r.vec_id, r.n, case when len(list_filter(k.xs, lambda b: r.x < b.x + b.w and b.x < r.x + r.w and r.y < b.y + b.h and b.y < r.y + r.h)) > 0 then k.xs else list_append(k.xs, {{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}}) end
        from kept k join good r on r.vec_id = k.vec_id and r.n = k.n + 1)
    select vec_id, b.x as x, b.y as y, b.w as w, b.h as h from (select vec_id, unnest(xs) as b from kept qualify n = max(n) over (partition by vec_id))""")
def o10_larger_marks(spark: SparkSession, d: str) -> DataFrame:
    """Components of the size of marks, of overlapping ones the largest."""
    ship(spark)
    found = _drawn(spark, d).select("vec_id", F.posexplode(shapes.shape_udf(shapes.dark_components)("height", "width", "pixels")).alias("ord", "b")).select("vec_id", "ord", "b.*")
    good = found.filter(F.col("w").between(10, 50) & F.col("h").between(10, 50) & (F.col("w") / F.col("h")).between(0.7, 1.4))
    return L.larger_marks(good, "vec_id").select("vec_id", "x", "y", "w", "h")


@query()
def r2_image_structure(spark: SparkSession, d: str) -> DataFrame:
    """From pixels to the structure score: edges, lines, counts. Votes have no SQL; tests count drawn lines."""
    ship(spark)
    return _drawn(spark, d).select("vec_id", S.image_structure(F.col("height"), F.col("width"), F.col("pixels")).alias("structure"))
