"""Queries of the frame time series and of scores and routing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import kernels, rules
from quillframe.functions.text import minutes, minutes_ms
from quillframe.operators import scoring as S
from quillframe.operators import near
from quillframe.operators import timeseries as T
from quillframe.shipping import ship

from .registry import FRAMES, frames, query, table

HOURS = 6 * 3600 * 1000

#: Openings of anchored windows: each next one is the first frame `width` or more after the last.
WINDOWS = f"""with recursive {FRAMES},
    opened(job_id, start) as (
        select job_id, min(timestamp_ms) from frames group by job_id
        union all
        select o.job_id, (select min(f.timestamp_ms) from frames f where f.job_id = o.job_id and f.timestamp_ms >= o.start + {HOURS}) from opened o
        where exists (select 1 from frames f where f.job_id = o.job_id and f.timestamp_ms >= o.start + {HOURS})),
    placed as (select f.*, o.start from frames f asof join opened o on f.job_id = o.job_id and f.timestamp_ms >= o.start)"""


@query(WINDOWS + " select job_id, event_id, timestamp_ms from placed qualify row_number() over (partition by job_id, start order by timestamp_ms, event_id) = 1")
def t1_gap_sampler(spark: SparkSession, d: str) -> DataFrame:
    return T.sample_gaps(frames(spark, d), "job_id", "timestamp_ms", HOURS, "event_id").select("job_id", "event_id", "timestamp_ms")


# The state of the sampler: value of the last kept frame, next time to look.
@query(f"""with recursive {FRAMES}, f as (select *, row_number() over (partition by job_id order by timestamp_ms, event_id) as n from frames),
    s(job_id, n, event_id, timestamp_ms, kept, next, take) as (
        select job_id, n, event_id, timestamp_ms, value, timestamp_ms + {HOURS}::double, true from f where n = 1
        union all
        select job_id, n, event_id, timestamp_ms, case when look and sim <= 0.98 then value else kept end,
            case when not look then next when sim < 0.93 then timestamp_ms + 0.75 * {HOURS}::double else timestamp_ms + {HOURS}::double end, look and sim <= 0.98
        from (select f.job_id, f.n, f.event_id, f.timestamp_ms, f.value, s.kept, s.next, f.timestamp_ms >= s.next as look, greatest(0.0, 1 - abs(f.value - s.kept) / 500.0) as sim
              from s join f on f.job_id = s.job_id and f.n = s.n + 1))
    select job_id, event_id, timestamp_ms from s where take""")
def t1_adaptive_sampler(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("job_id", "event_id", "timestamp_ms", "value")
    return T.sample_adaptive(f, "job_id", "timestamp_ms", "value", "event_id", HOURS, T.scalar_likeness(500.0)).select("job_id", "event_id", "timestamp_ms")


@query("""with p as (select vec_id, embedding::double[] as b, lag(embedding::double[]) over (partition by label order by vec_id) as a from embeddings),
    c as (select vec_id, list_transform(a, lambda x: x - list_sum(a) / len(a)) as a, list_transform(b, lambda x: x - list_sum(b) / len(b)) as b from p)
    select vec_id, round(coalesce(case when sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) < 1e-6 then 1.0
        else list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) end, 0.0), 6) as similarity from c""")
def t2_cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(T.in_order("label", "vec_id", "vec_id")))
    return e.select("vec_id", F.round(T.cross_correlation(F.col("before"), F.col("embedding")), 6).alias("similarity"))


@query(f"""with {FRAMES}, p as (select *, lag(value) over (partition by job_id order by timestamp_ms, event_id) as before from frames)
    select job_id, event_id, round(case when before is null then 0.5 else greatest(0.0, 1 - (value - before) * (value - before) / 250000.0) end, 6) as stability from p""")
def t4_stability(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.select("job_id", "event_id", F.round(T.stability(F.col("value"), T.in_order("job_id", "timestamp_ms", "event_id"), 500.0), 6).alias("stability"))


# The SQL keeps the state of each job from frame to frame: the last kept value, second value and time, and the first-pass similarities so far.
@query(f"""with recursive {FRAMES}, f as (select *, (frame_index * 37 % 300)::double as fine, row_number() over (partition by job_id order by timestamp_ms, event_id) as n from frames),
    s(job_id, n, event_id, kept, kept_fine, kept_ts, recent, score, is_change) as (
        select job_id, n, event_id, value, fine, timestamp_ms, []::double[], 1.0::double, true from f where n = 1
        union all
        select job_id, n, event_id, case when change then value else kept end, case when change then fine else kept_fine end, case when change then timestamp_ms else kept_ts end, recent,
            round(greatest(0.0, 1 - case when sim between 0.6 and 0.95 then exact else sim end), 4), change
        from (select *, timestamp_ms - kept_ts >= 2000 and (sim < 0.6 or (sim <= 0.95 and exact < case when len(recent) < 5 then 0.85
                    when list_var_pop(recent) > 0.02 then 0.88 when list_var_pop(recent) < 0.005 then 0.83 else 0.85 end)) as change
              from (select f.job_id, f.n, f.event_id, f.value, f.fine, f.timestamp_ms, s.kept, s.kept_fine, s.kept_ts, greatest(0.0, 1 - abs(f.value - s.kept) / 300.0) as sim,
                           greatest(0.0, 1 - abs(f.fine - s.kept_fine) / 300.0) as exact, (list_append(s.recent, greatest(0.0, 1 - abs(f.value - s.kept) / 300.0)))[-20:] as recent
                    from s join f on f.job_id = s.job_id and f.n = s.n + 1)))
    select job_id, event_id, score, is_change from s""")
def t5_change_detector(spark: SparkSession, d: str) -> DataFrame:
    pair = F.array("value", (F.col("frame_index") * 37 % 300).cast("double"))
    f = frames(spark, d).select("job_id", "event_id", "timestamp_ms", pair.alias("frame"))
    rough, fine = (lambda i: lambda a, b: max(0.0, 1 - abs(b[i] - a[i]) / 300.0))(0), (lambda i: lambda a, b: max(0.0, 1 - abs(b[i] - a[i]) / 300.0))(1)
    return T.detect_changes(f, "job_id", "timestamp_ms", "frame", "event_id", rough, fine).select("job_id", "event_id", "score", "is_change")


@query("""with g as (select vec_id, list_transform(embedding[1:36], lambda x: cast(floor(abs(x::double) * 1000) as int) % 256) as p from embeddings),
    grid as (select y, x from range(6) a(y), range(6) b(x)),
    cells as (select vec_id, p[6 * y + x + 1] as c, p[6 * (case when y = 0 then 1 else y - 1 end) + x + 1] + p[6 * (case when y = 5 then 4 else y + 1 end) + x + 1]
        + p[6 * y + case when x = 0 then 1 else x - 1 end + 1] + p[6 * y + case when x = 5 then 4 else x + 1 end + 1] as around from g, grid)
    select vec_id, round(least(var_pop(around - 4 * c) / 5000, 1.0), 4) as blur_score from cells group by vec_id""")
def t3_blur_score(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _images(spark, d, 6, 6).select("vec_id", kernels.kernel_udf(kernels.blur_score)("height", "width", "pixels").alias("blur_score"))


def _images(spark: SparkSession, d: str, height: int, width: int) -> DataFrame:
    """Vectors as small grey images."""
    n = height * width
    values = F.transform(F.slice("embedding", 1, n), lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("int") % 256)
    pixels = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return table(spark, d, "embeddings").select("vec_id", "label", F.lit(height).alias("height"), F.lit(width).alias("width"), pixels.alias("pixels"))


@query()
def t5_change_detector_images(spark: SparkSession, d: str) -> DataFrame:
    """Both passes on pixels: low frequencies, then structure and colours."""
    f = _images(spark, d, 7, 9).select(F.col("label").alias("job_id"), "vec_id", (F.col("vec_id") * 700).alias("timestamp_ms"), "pixels")
    colour = lambda raw: np.repeat(kernels.image(raw, 7, 9, 1)[:, :, None], 3, axis=2)
    rough = lambda a, b: kernels.hash_likeness(colour(a), colour(b))
    fine = lambda a, b: kernels.precise_likeness(colour(a), colour(b))
    return T.detect_changes(f, "job_id", "timestamp_ms", "pixels", "vec_id", rough, fine).select("job_id", "vec_id", "score", "is_change")


@query()
def t10_dct_hash(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    ones = kernels.kernel_udf(lambda image: float(kernels.dct_hash(image).sum()))
    density = kernels.kernel_udf(kernels.text_density)
    return _images(spark, d, 8, 8).select("vec_id", ones("height", "width", "pixels").alias("ones"), density("height", "width", "pixels").alias("text_density"))


@query(f"""with {FRAMES}, s as (select job_id, event_id, var_pop(value / 500) over w as var, count(*) over w as n from frames
        window w as (partition by job_id order by timestamp_ms, event_id rows between 19 preceding and current row))
    select job_id, event_id, case when n < 5 then 0.85 when var > 0.02 then 0.88 when var < 0.005 then 0.83 else 0.85 end as threshold from s""")
def t6_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    threshold = T.rolling_threshold(F.col("value") / 500, T.in_order("job_id", "timestamp_ms", "event_id"))
    return frames(spark, d).select("job_id", "event_id", F.round(threshold, 2).alias("threshold"))


@query("""select b.label, b.vec_id, coalesce(max(case when a.vec_id is not null then 1 - abs(a.embedding[1] - b.embedding[1])::double end) > 0.995, false) as redundant
    from embeddings b left join embeddings a on a.label = b.label and a.vec_id < b.vec_id group by 1, 2""")
def t7_redundant(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("v"))
    return near.redundant_values(e, "label", "vec_id", "v", 0.995).select("label", "vec_id", "redundant")


SIGNS = """h as (select vec_id, label, list_transform(embedding[1:64], lambda x: (x::double) > list_sum(embedding[1:64]::double[]) / 64) as bits from embeddings)"""


@query(f"""with recursive {SIGNS}, r as (select label, vec_id, bits, row_number() over (partition by label order by vec_id % 17 desc, vec_id) as n from h),
    k(label, n, kept, ids) as (
        select label, 0::bigint, []::boolean[][], []::bigint[] from r group by label
        union all
        select r.label, r.n, case when near then kept else list_append(kept, bits) end, case when near then ids else list_append(ids, vec_id) end
        from (select r.*, k.kept, k.ids, len(list_filter(k.kept, lambda b: 1 - len(list_filter(list_zip(b, r.bits), lambda z: z[1] <> z[2])) / 64.0 >= 0.62)) > 0 as near from k join r on r.label = k.label and r.n = k.n + 1) r)
    select label, unnest(ids) as vec_id from k qualify n = max(n) over (partition by label)""")
def t8_greedy_distinct(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") % 17).alias("score"), T.sign_hash(F.col("embedding")).alias("hash"))
    return near.distinct_frames(e, "label", "score", "vec_id", "hash", 0.62).select("label", "vec_id")


# Frames that show one of 97 vectors with a few signs turned over: real near copies, by the thousand, for the likeness that jobs use.
TURNED = """base as (select vec_id, list_transform(embedding[1:64], lambda x: (x::double) > list_sum(embedding[1:64]::double[]) / 64) as bits from embeddings where vec_id < 97),
    shown as (select event_id, user_id % 5 as job, event_id % 97 as vec_id, event_id * 7919 % 64 as p, event_id % 4 as flips, event_id * 31 % 1009 as score from events),
    t as (select job, event_id, score, list_transform(range(64), lambda i: case when flips > 0 and (i - p + 64) % 64 < flips then not bits[i + 1] else bits[i + 1] end) as bits from shown join base using (vec_id))"""


def _turned(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    base = table(spark, d, "embeddings").filter("vec_id < 97").select("vec_id", T.sign_hash(F.col("embedding")).alias("hash"))
    shown = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("job"), (n % 97).alias("vec_id"), (n * 7919 % 64).cast("int").alias("p"), (n % 4).cast("int").alias("flips"), (n * 31 % 1009).alias("score"))
    turn = F.expr("shiftleft(shiftleft(1L, flips) - 1L, p) | if(p + flips > 64, shiftrightunsigned(shiftleft(1L, flips) - 1L, 64 - p), 0L)")
    return shown.join(F.broadcast(base), "vec_id").select("job", "event_id", "score", F.col("hash").bitwiseXOR(turn).alias("hash"))


@query(f"""with recursive {TURNED}, b as (select job, bits, arg_min(event_id, (-score, event_id)) as event_id, max(score) as score from t group by job, bits),
    r as (select job, event_id, bits, row_number() over (partition by job order by score desc, event_id) as n from b),
    k(job, n, kept, ids) as (select job, 0::bigint, []::boolean[][], []::bigint[] from r group by job union all
        select job, n, case when near then kept else list_append(kept, bits) end, case when near then ids else list_append(ids, event_id) end
        from (select r.*, k.kept, k.ids, len(list_filter(k.kept, lambda b: len(list_filter(list_zip(b, r.bits), lambda z: z[1] <> z[2])) <= 5)) > 0 as near from k join r on r.job = k.job and r.n = k.n + 1))
    select job, unnest(ids) as event_id from k qualify n = max(n) over (partition by job)""")
def t8_distinct_frames(spark: SparkSession, d: str) -> DataFrame:
    return near.distinct_frames(_turned(spark, d), "job", "score", "event_id", "hash", 0.92).select("job", "event_id")


@query(f"""with {TURNED}, b as (select job, bits, min(event_id) as first from t group by job, bits),
    e as (select y.job, y.bits, min(x.first) as near from b x join b y on x.job = y.job and len(list_filter(list_zip(x.bits, y.bits), lambda z: z[1] <> z[2])) <= 7 group by all)
    select t.job, t.event_id, e.near < t.event_id as redundant from t join e using (job, bits)""")
def t7_redundant_frames(spark: SparkSession, d: str) -> DataFrame:
    return near.redundant_hashes(_turned(spark, d), "job", "event_id", "hash", 0.88).select("job", "event_id", "redundant")


@query(f"""with {SIGNS} select a.label, a.vec_id, 1 - len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2])) / 64.0 as similarity
    from (select *, lead(vec_id) over (partition by label order by vec_id) as nxt from h) a join h b on b.vec_id = a.nxt""")
def t9_hamming(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", T.sign_hash(F.col("embedding")).alias("hash"))
    following = F.lead("hash").over(T.in_order("label", "vec_id", "vec_id"))
    return e.withColumn("next", following).filter("next is not null").select("label", "vec_id", T.hamming_similarity(F.col("hash"), F.col("next")).alias("similarity"))


@query(f"with {FRAMES} select event_id, round(0.40 * (value / 500) + 0.20 * (k / 100.0) + 0.25 * ((frame_index % 10) / 10.0) + 0.15 * ((k % 7) / 7.0), 6) as importance from frames")
def t12_visual_importance(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    score = S.visual_importance(F.col("value") / 500, F.col("k") / 100, (F.col("frame_index") % 10) / 10, (F.col("k") % 7) / 7)
    return f.select("event_id", F.round(score, 6).alias("importance"))


@query(f"with {FRAMES} select event_id, round(greatest(0.0, least(1.0, 0.35 * (value / 100) + 0.45 * (k / 100.0) + 0.20 * coalesce(case when k % 5 > 0 then (k % 5) / 5.0 end, 0.5))), 6) as composite from frames")
def t13_composite(spark: SparkSession, d: str) -> DataFrame:
    stability = F.when(F.col("k") % 5 > 0, (F.col("k") % 5) / 5)
    return frames(spark, d).select("event_id", F.round(S.composite(F.col("value") / 100, F.col("k") / 100, stability), 6).alias("composite"))


@query(WINDOWS + " select job_id, start as window_start, event_id, value from placed qualify row_number() over (partition by job_id, start order by value desc, timestamp_ms, event_id) = 1")
def t14_best_per_window(spark: SparkSession, d: str) -> DataFrame:
    return T.best_per_window(frames(spark, d), "job_id", "timestamp_ms", "value", HOURS, "event_id").select("job_id", "window_start", "event_id", "value")


@query(WINDOWS + " select job_id, event_id, row_number() over (partition by job_id, start order by k desc, timestamp_ms, event_id) > 1 as redundant from placed")
def t15_consolidated(spark: SparkSession, d: str) -> DataFrame:
    return T.consolidate(frames(spark, d), "job_id", "timestamp_ms", "k", HOURS, "event_id").select("job_id", "event_id", "redundant")


@query(f"with {FRAMES} select job_id, event_id, timestamp_ms, case when k % 3 = 0 then 0.0 else value end as candidate_score from frames where section = 'error' order by timestamp_ms, event_id")
def t16_selected(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).filter("section = 'error'").orderBy("timestamp_ms", "event_id")
    return f.select("job_id", "event_id", "timestamp_ms", S.candidate_score(F.col("k") % 3 == 0, F.col("value")).alias("candidate_score"))


@query("""with c as (select event_id, greatest(0, least(cast(event_id % 900 as int) - 100, 640)) as x1, greatest(0, least(cast(event_id % 700 as int) - 100, 480)) as y1,
        greatest(0, least(cast(event_id % 900 as int) + 50, 640)) as x2, greatest(0, least(cast(event_id % 700 as int) + 20, 480)) as y2 from events)
    select event_id, x1, y1, x2, y2 from c where x2 > x1 and y2 > y1""")
def t18_crop(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    box = S.crop((n % 900).cast("int") - 100, (n % 700).cast("int") - 100, F.lit(150), F.lit(120), F.lit(640), F.lit(480))
    return table(spark, d, "events").select("event_id", box.alias("b")).filter("b is not null").select("event_id", "b.*")


@query(f"""with {FRAMES}, s as (select job_id, (max(timestamp_ms) - min(timestamp_ms)) % 400000 as ms from frames group by job_id),
    t as (select job_id, ms, case when ms / 1000.0 <= 30 then 5 when ms / 1000.0 <= 120 then 15 when ms / 1000.0 <= 300 then 30 else 60 end as step from s)
    select job_id, unnest(range(0, ms // 1000 + 1, step)) as tick from t""")
def t19_ruler(spark: SparkSession, d: str) -> DataFrame:
    s = frames(spark, d).groupBy("job_id").agg(((F.max("timestamp_ms") - F.min("timestamp_ms")) % 400000).alias("ms"))
    return s.select("job_id", F.explode(T.ticks(F.col("ms"))).alias("tick")).withColumn("tick", F.col("tick").cast("long"))


@query("""select event_id, printf('%02d:%02d', (event_id * 377) // 60000, (event_id * 377) // 1000 % 60) as short,
    printf('%02d:%02d.%03d', (event_id * 377) // 60000, (event_id * 377) // 1000 % 60, (event_id * 377) % 1000) as long from events""")
def t20_clock(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("event_id") * 377
    return table(spark, d, "events").select("event_id", minutes(ms).alias("short"), minutes_ms(ms).alias("long"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Words that occur in the invented texts stand for the keywords.
WORDS = ["token", "the", "example", "tion", "keit", "password", "que", "income"]


@query(f"""with m as (select doc_id, list_filter({_list(WORDS)}, lambda k: contains(lower(text), k)) as matched from documents)
    select doc_id, array_to_string(matched, ',') as matched, round(least(len(matched) / greatest(0.3 * {len(WORDS)}, 1.0), 1.0), 6) as score from m""")
def r1_keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", F.array_join(S.matched_keywords(F.col("text"), WORDS), ",").alias("matched"), F.round(S.keyword_relevance(F.col("text"), WORDS), 6).alias("score"))


@query(f"""select doc_id, round(least(len(list_filter({_list(rules.RELEVANCE_KEYWORDS)}, lambda k: contains(lower(text), k))) / greatest(0.3 * 21, 1.0), 1.0), 6) as score from documents""")
def r1_default_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(S.keyword_relevance(F.col("text")), 6).alias("score"))


@query(f"with {FRAMES} select event_id, round(0.6 * least((k % 15) / 10.0, 1.0) + 0.4 * least((frame_index % 8) / 5.0, 1.0), 6) as structure from frames")
def r2_line_structure(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("event_id", F.round(S.line_structure(F.col("k") % 15, F.col("frame_index") % 8), 6).alias("structure"))


@query("""select doc_id, round(case when trim(case when doc_id % 4 = 0 then ' ' else text end) <> '' then 0.7 * (doc_id % 10) / 10.0 + 0.3 * (doc_id % 7) / 7.0 else (doc_id % 7) / 7.0 end, 6) as relevance from documents""")
def r3_relevance(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 4 == 0, " ").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(S.relevance(text, (n % 10) / 10, (n % 7) / 7), 6).alias("relevance"))


SECTIONS = {"first": ["token", "the", "mail"], "second": ["tion", "que", "ment", "eau"], "table": ["keit", "ung", "|"], "fourth": ["ción", "los"]}
_scores = " union all ".join(
    f"select doc_id, '{name}' as section, {rank} as ord, " + (f"case when s >= 0.4 then least({share} + 0.3 * s, 1.0) else {share} end" if name == "table" else share) + " as score from t"
    for rank, (name, words) in enumerate(SECTIONS.items()) for share in [f"len(list_filter({_list(words)}, lambda k: contains(lower(text), k))) / {float(len(words))}"]
)


@query(f"""with t as (select doc_id, text, (doc_id % 10) / 10.0 as s from documents), scores as ({_scores}),
    best as (select * from scores qualify row_number() over (partition by doc_id order by score desc, ord) = 1)
    select doc_id, case when score >= 0.1 then section else 'unknown' end as section_type, round(case when score >= 0.1 then score else 0.0 end, 6) as confidence from best""")
def r4_rule_class(spark: SparkSession, d: str) -> DataFrame:
    c = S.classify_by_rules(F.col("text"), (F.col("doc_id") % 10) / 10, section_rules=SECTIONS)
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.section_type", F.round("c.confidence", 6).alias("confidence"))


_HEAD = "case k % 8 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(rules.HEADINGS)) + " end"
_NAME = "case k % 8 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(rules.HEADINGS.values())) + " end"
_ORDER = "case k % 8 " + " ".join(f"when {i} then {v}" for i, v in enumerate(rules.ORDER_WEIGHTS.values())) + " end"


@query(f"""with {FRAMES}, s as (select *, {_HEAD} as section_type, {_NAME} as heading, {_ORDER} as weight, case when k % 5 = 0 then '' else 'Step ' || k end as body, (k % 10) / 10.0 as conf from frames)
    select event_id, section_type, heading, weight as order_suggestion,
        'This section (captured at ' || printf('%.1f', (frame_index * 1500) / 1000.0) || 's) ' || case when body <> '' then 'contains content related to ' || lower(heading) || '. Extracted text begins: "' || body || '..."'
            else 'appears to contain content related to ' || lower(heading) || '. Full text extraction pending OCR integration.' end as summary,
        array_to_string(list_filter(['Matched 1 relevant keyword(s): form', case when section_type = 'table' then 'Visual structure suggests tabular or form data.' end,
            case when conf >= 0.5 then 'Classification confidence: ' || (k % 10) * 10 || '%.' else 'Low classification confidence (' || (k % 10) * 10 || '%); manual review recommended.' end,
            case when body = '' then 'OCR text not yet available — synthesis is preliminary.' end], lambda x: x is not null), ' / ') as key_points from s""")
def r5_synthesis(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in rules.HEADINGS])
    f = frames(spark, d).select("event_id", F.get(names, F.col("k") % 8).alias("section_type"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("Step "), F.col("k").cast("string"))).alias("body"), ((F.col("k") % 10) / 10).alias("conf"), (F.col("frame_index") * 1500).alias("ms"))
    c = S.synthesize(F.col("section_type"), F.col("body"), F.array(F.lit("form")), F.col("conf"), F.col("ms"))
    return f.select("event_id", "section_type", c["heading"].alias("heading"), c["order_suggestion"].alias("order_suggestion"), c["summary"].alias("summary"), F.array_join(c["key_points"], " / ").alias("key_points"))


_ROUTE = "case k % 8 " + " ".join(f"when {i} then {v}" for i, v in enumerate(rules.SECTION_BUCKETS.values())) + " end"
_SECTION_OF = "case k % 8 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(rules.SECTION_BUCKETS)) + " end"
_BY_LABEL = "case k % 11 " + " ".join(f"when {i} then {v}" for i, v in enumerate(rules.LABEL_BUCKETS.values())) + " end"


def _routed(spark: SparkSession, d: str) -> DataFrame:
    section = F.get(F.array(*[F.lit(x) for x in rules.SECTION_BUCKETS]), F.col("k") % 8)
    label = F.get(F.array(*[F.lit(x) for x in rules.LABEL_BUCKETS]), F.col("k") % 11)
    return frames(spark, d).select("event_id", section.alias("section_type"), label.alias("label"), S.report_bucket(section, label).alias("bucket"))


@query(f"with {FRAMES} select event_id, {_SECTION_OF} as section_type, coalesce({_BY_LABEL}, {_ROUTE}, 5) as bucket from frames")
def r6_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).drop("label")


@query(f"with {FRAMES}, r as (select coalesce({_BY_LABEL}, {_ROUTE}, 5) as bucket from frames) select b.bucket, count(r.bucket) as n from (values (1), (2), (3), (4), (5)) b(bucket) left join r using (bucket) group by 1")
def r7_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.bucket_counts(_routed(spark, d))
