"""Queries of filters, ordered look-ups, joins and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions.text import blank_to, frame_ref
from quillframe.operators import lookups as L
from quillframe.sources import readers

from .registry import FRAMES, frames, query, table


@query(f"""with {FRAMES} select job_id, event_id, frame_index, timestamp_ms, value as relevance_score from frames where value >= 20
    order by timestamp_ms, event_id limit 500""")
def c1_frames_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("relevance_score", F.col("value"))
    return L.frames_of(f, 20.0, 500, order="event_id").select("job_id", "event_id", "frame_index", "timestamp_ms", "relevance_score")


@query(f"with {FRAMES} select job_id, event_id, timestamp_ms from frames where section = 'click' and k % 2 = 0")
def c2_screenshots_by_type(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumns({"section_type": F.col("section"), "accepted": F.col("k") % 2 == 0, "order_index": F.col("frame_index"), "captured_at_ms": F.col("timestamp_ms")})
    return L.screenshots_of(f, "click", True).select("job_id", "event_id", "timestamp_ms")


@query("select o_custkey as job_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as position from orders")
def c3_sections_in_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("final_order"))
    return L.in_order(o, "job_id", ["final_order", "id"]).drop("final_order")


@query("select o_orderkey as job_id, o_orderstatus as status, o_totalprice as size from orders order by o_orderdate desc, o_orderkey")
def c4_jobs_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return L.newest_first(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))


@query(f"with {FRAMES} select job_id, event_id, timestamp_ms, section from frames qualify row_number() over (partition by job_id order by timestamp_ms desc, event_id desc) = 1")
def c5_latest_report(spark: SparkSession, d: str) -> DataFrame:
    return L.newest(frames(spark, d).select("job_id", "event_id", "timestamp_ms", "section"), "job_id", "timestamp_ms", "event_id").select("job_id", "event_id", "timestamp_ms", "section")


@query(f"with {FRAMES} select event_id, job_id, section, k from frames where section = 'view' order by timestamp_ms desc, event_id desc limit 500")
def c6_results_newest(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("frame_id", F.col("section"))
    return L.results(f, frame_id="view", limit=1000, at="timestamp_ms", tie="event_id").select("event_id", "job_id", "section", "k")


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, length(props) as size from events")
def c7_json_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", L.decoded(F.col("props"), "k int")["k"].alias("k"), F.char_length("props").alias("size"))


@query("""with p as (select page_id, url, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) as extension from pages)
    select page_id, extension, case when coalesce(url, '') = '' then 'no path' when extension not in ('org', 'com', 'net') then 'unsupported extension: ' || extension when length(url) = 0 then 'empty file' when length(url) > 60 then 'too large' end as error from p""")
def c8_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", readers.extension(F.col("url")).alias("extension"), readers.file_error(F.col("url"), F.char_length("url"), ["org", "com", "net"], 60).alias("error"))


@query("""select d.doc_id, coalesce(nullif(case when l.quality = 1 then '' else d.source end, ''), d.lang) as shown
    from documents d left join labels l on d.doc_id = l.doc_id""")
def c9_coalesced_text(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", blank_to(F.when(F.col("quality") == 1, "").otherwise(F.col("source")), F.col("lang")).alias("shown"))


@query(f"""with {FRAMES} select job_id, event_id, k % 3 = 0 and frame_index > 0 as redundant,
    case when value > 1 then value / 100 when value > 0 then value else k % 3 end as confidence from frames""")
def c10_list_filters(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("k") % 3).cast("double")
    return frames(spark, d).select("job_id", "event_id", L.redundant_in_list(score, F.col("frame_index")).alias("redundant"), L.shown_confidence(F.col("value"), score).alias("confidence"))


@query(f"""with {FRAMES}, t as (select min(timestamp_ms) + 1000000000 as t from frames)
    select job_id, event_id, timestamp_ms from frames, t qualify row_number() over (partition by job_id order by abs(timestamp_ms - t), event_id) = 1""")
def c11_nearest_frame(spark: SparkSession, d: str) -> DataFrame:
    from quillframe.operators.timeseries import nearest

    f = frames(spark, d)
    at = f.agg((F.min("timestamp_ms") + 1_000_000_000).alias("t"))
    return nearest(f.join(F.broadcast(at)), "job_id", "timestamp_ms", F.col("t"), "event_id").select("job_id", "event_id", "timestamp_ms")


@query(f"with {FRAMES} select job_id, count(*) filter (value >= 50) as shown, count(*) as total from frames group by job_id")
def c12_confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.shown_of_total(frames(spark, d), "job_id", "value", 50)


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def c13_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return L.not_in(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("""with f as (select o_custkey as job_id, printf('frame_%06d', cast(o_orderkey % 7 as int)) as ref, arg_max(o_orderkey, o_orderkey) as frame_id from orders group by 1, 2),
    s as (select o_custkey as job_id, printf('frame_%06d', cast(o_orderkey % 5 as int)) as ref, o_orderkey as shot from orders)
    select s.job_id, s.ref, s.shot, f.frame_id from s left join f on s.job_id = f.job_id and s.ref = f.ref""")
def d1_shots_with_frames(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderkey")
    shots = o.select("job_id", frame_ref((F.col("o_orderkey") % 5).cast("int")).alias("ref"), F.col("o_orderkey").alias("shot"))
    made = o.select("job_id", (F.col("o_orderkey") % 7).cast("int").alias("index"), F.col("o_orderkey").alias("frame_id"))
    return L.left_by_ref(shots, made, "job_id", "index", "ref", "frame_id").select("job_id", "ref", "shot", "frame.frame_id")


@query("""with s as (select o_custkey as c_custkey, max(o_orderkey) as shot from orders group by 1) select c.c_custkey, c.c_name, s.shot from customer c left join s using (c_custkey)""")
def d2_frames_with_shots(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("shot"))
    return L.with_last(table(spark, d, "customer").select("c_custkey", "c_name"), shots, "c_custkey", "shot").select("c_custkey", "c_name", "last.shot")


@query("""with f as (select o_custkey as c_custkey, arg_min(o_orderpriority, o_orderkey) as heading from orders group by 1)
    select c.c_custkey, coalesce(f.heading, upper(left(c.c_mktsegment, 1)) || lower(substr(c.c_mktsegment, 2))) as heading from customer c left join f using (c_custkey)""")
def d3_section_or_default(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("heading"))
    return L.first_or_default(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), sections, "c_custkey", "o_orderkey", {"heading": F.initcap("c_mktsegment")}).select("c_custkey", "heading")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def d4_not_selected(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return L.not_in(table(spark, d, "customer").select("c_custkey", "c_name"), large, ["c_custkey"])


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def d5_promoted(spark: SparkSession, d: str) -> DataFrame:
    return L.already_in(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"""with {FRAMES}, a as (select job_id, event_id, row_number() over (partition by job_id order by event_id) as pos from frames where section = 'click'),
    b as (select job_id, event_id as other, row_number() over (partition by job_id order by event_id) as pos from frames where section = 'view')
    select a.job_id, a.event_id, b.other from a join b using (job_id, pos)""")
def d6_by_position(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("job_id", "event_id", "section")
    a = f.filter("section = 'click'").drop("section")
    return L.by_position(a, f.filter("section = 'view'").select("job_id", F.col("event_id").alias("other")), "job_id", "event_id", "other")


BOXES = """words as (select user_id % 20 as image, event_id as ord, (event_id * 37) % 640 as x, (event_id * 61) % 480 as y, event_type as text, cast(floor(value) as int) % 100 as conf from events),
    boxes as (select image, box, (image * 31 + box * 97) % 500 as x, (image * 17 + box * 53) % 400 as y, 90 + box * 11 as w, 60 + box * 7 as h from range(20) r(image), range(8) b(box))"""


@query(f"""with {BOXES}, hit as (select w.image, w.ord, w.text, w.conf, min(b.box) as box from words w join boxes b on w.image = b.image
        and w.x between b.x and b.x + b.w and w.y between b.y and b.y + b.h group by all)
    select image, box, string_agg(text, ' ' order by ord) as text, max(conf) / 100.0 as confidence from hit group by image, box""")
def d7_words_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "events").select((F.col("user_id") % 20).alias("image"), F.col("event_id").alias("ord"), (F.col("event_id") * 37 % 640).alias("x"), (F.col("event_id") * 61 % 480).alias("y"), F.col("event_type").alias("text"), (F.floor("value").cast("int") % 100).alias("conf"))
    b = spark.range(20).withColumnRenamed("id", "image").withColumn("box", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    boxes = b.withColumns({"x": (F.col("image") * 31 + F.col("box") * 97) % 500, "y": (F.col("image") * 17 + F.col("box") * 53) % 400, "w": 90 + F.col("box") * 11, "h": 60 + F.col("box") * 7})
    return L.in_first_box(words, boxes, "image")


# A user's events as boxes, on a page for each eight of them.
_EVENT_BOXES = """boxes as (select user_id * 100000 + (row_number() over (partition by user_id order by event_id) - 1) // 8 as image, event_id as box, (event_id * 31) % 500 as x, (event_id * 17) % 400 as y, 90 + event_id % 77 as w, 60 + event_id % 49 as h from events)"""


@query(f"""with {_EVENT_BOXES} select a.image, a.box, max(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) > 0.3 * min(a.w * a.h) as covered
    from boxes a join boxes b on a.image = b.image and a.box <> b.box group by a.image, a.box""")
def d8_box_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    page = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 8)
    boxes = table(spark, d, "events").select((F.col("user_id") * 100000 + page).alias("image"), n.alias("box"), F.struct((n * 31 % 500).alias("x"), (n * 17 % 400).alias("y"), (90 + n % 77).alias("w"), (60 + n % 49).alias("h")).alias("a"))
    other = boxes.select("image", F.col("box").alias("_box"), F.col("a").alias("b"))
    met = boxes.join(other, "image").filter("box != _box")
    return met.groupBy("image", "box").agg((F.max(L.overlaps(F.col("a"), F.col("b"))) > 0.3 * F.min(F.col("a.w") * F.col("a.h"))).alias("covered"))


@query("""with d as (select o_custkey as job, o_orderpriority as name, o_orderkey as doc, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as n from orders where o_orderkey % 2 = 0),
    f as (select o_custkey as job, o_orderpriority as name, o_orderkey as file, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as n from orders where o_orderkey % 3 = 0),
    named as (select d.job, d.doc, f.file from d join f using (job, name, n)),
    rd as (select job, doc, row_number() over (partition by job order by doc) as n from d where not exists (select 1 from named x where x.job = d.job and x.doc = d.doc)),
    rf as (select job, file, row_number() over (partition by job order by file) as n from f where not exists (select 1 from named x where x.job = f.job and x.file = f.file))
    select * from named union all select rd.job, rd.doc, rf.file from rd left join rf using (job, n)""")
def d10_files_to_documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("name"), "o_orderkey")
    docs = o.filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "doc")
    return L.match_files(docs, o.filter("o_orderkey % 3 = 0").withColumnRenamed("o_orderkey", "file"), "name", "doc", "file", "job")


@query(f"with {FRAMES} select job_id, count(*) as frame_count, count(*) filter (section = 'purchase') as screenshot_count, bool_or(k > 95) as running from frames group by job_id")
def k9_job_counters(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("job_id").agg(F.count("*").alias("frame_count"), F.count_if(F.col("section") == "purchase").alias("screenshot_count"), F.bool_or(F.col("k") > 95).alias("running"))


@query("select o_orderkey, case when o_totalprice > 200000 then 'failed' else o_orderstatus end as status, case when o_totalprice > 200000 then 0 else o_totalprice end as size from orders")
def b2_update(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))
    return L.update(o, F.col("size") > 200000, {"status": F.lit("failed"), "size": F.lit(0.0)})


@query("""select 'orders' as name, count(*) as n from orders where o_custkey % 3 <> 0 union all select 'customer', count(*) from customer where c_custkey % 3 <> 0""")
def b3_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "job_id"), "customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "job_id")}
    gone = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id")).unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"))).distinct().filter("job_id % 3 = 0")
    left = L.delete_cascade(tables, gone)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("""with f as (select page_id, 'a/' || page_id || case page_id % 5 when 0 then '.mp4' when 1 then '.MOV' when 2 then '.txt' when 3 then '.webm' else '' end as path, (page_id % 4) * 1000000000 as size from pages)
    select page_id, case when lower(regexp_extract(path, '\\.([^./]+)$', 1)) not in ('mp4', 'mov', 'avi', 'mkv', 'webm') then 'unsupported extension: ' || lower(regexp_extract(path, '\\.([^./]+)$', 1))
        when size = 0 then 'empty file' when size > 2147483648 then 'too large' end as error from f""")
def a2_validated_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    end = F.when(n % 5 == 0, ".mp4").when(n % 5 == 1, ".MOV").when(n % 5 == 2, ".txt").when(n % 5 == 3, ".webm").otherwise("")
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("a/"), n.cast("string"), end).alias("path"), ((n % 4) * 1000000000).alias("size"))
    return p.select("page_id", readers.file_error(F.col("path"), F.col("size"), readers.VIDEO_EXTENSIONS, readers.VIDEO_BYTES).alias("error"))


@query("""select event_id, case when fps >= 500 or fps <= 0 or frames / fps * 1000 <= 0 then last else frames / fps * 1000 end as duration_ms
    from (select event_id, cast(event_id % 40 as double) as frames, cast(case when event_id % 9 = 0 then 600 when event_id % 11 = 0 then 0 else 25 end as double) as fps, value as last from events)""")
def a1_probe_duration(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    fps = F.when(n % 9 == 0, 600.0).when(n % 11 == 0, 0.0).otherwise(25.0)
    return table(spark, d, "events").select("event_id", readers.duration_ms((n % 40).cast("double"), fps, F.col("value")).alias("duration_ms"))


@query("select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'png' when 2 then 'jpg' end as kind from documents")
def a7_sniffed_uploads(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.when(n % 4 == 0, F.concat(F.unhex(F.lit("255044462D")), F.encode("text", "utf-8"))).when(n % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(n % 4 == 2, F.unhex(F.lit("FFD8FFE000"))).otherwise(F.unhex(F.lit("00000000")))
    return table(spark, d, "documents").select("doc_id", readers.sniff(raw).alias("kind"))


@query("""select c_custkey, i as ord, cast(c_nationkey * 10 + i as int) as x, case when i = 2 then null else i * 30 end as conf, c_mktsegment || i as text
    from customer, range(1, 4) r(i) where i <> 3 or c_custkey % 2 = 0""")
def a10_recognised_words(spark: SparkSession, d: str) -> DataFrame:
    head = "block_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext"
    line = lambda i, conf: F.concat(F.lit("1\t1\t1\t"), (F.col("c_nationkey") * 10 + i).cast("string"), F.lit(f"\t2\t3\t4\t{conf}\t"), F.col("c_mktsegment"), F.lit(str(i)))
    third = F.when(F.col("c_custkey") % 2 == 0, line(3, 90)).otherwise("1\t2\tshort")
    tsv = F.concat_ws("\n", F.lit(head), line(1, 30), line(2, "x"), third)
    c = table(spark, d, "customer").select("c_custkey", tsv.alias("tsv"))
    return readers.recognised_words(c, "c_custkey", "tsv").select("c_custkey", (F.col("ord") + 1).alias("ord"), "x", "conf", "text")


@query(f"""with {FRAMES}, f as (select job_id, case when k % 20 = 0 then 100000 + frame_index else frame_index end as frame_index, timestamp_ms from frames)
    select * from f union all select job_id, 100000 + count(*) filter (frame_index >= 100000), 5000 from f group by job_id""")
def a4_manual_frames(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    made = f.select("job_id", F.when(F.col("k") % 20 == 0, 100000 + F.col("frame_index")).otherwise(F.col("frame_index")).cast("long").alias("frame_index"), "timestamp_ms")
    return L.add_manual_frame(made, F.col("job_id"), F.lit(5000).cast("long"), made.select("job_id").distinct())


@query(f"""with {FRAMES}, s as (select job_id, printf('frame_%06d', frame_index % 30) as ref, max(event_id) as note from frames group by all),
    n as (select f.job_id, f.event_id, s.note, row_number() over (partition by f.job_id order by timestamp_ms, f.event_id) - 1 as position from frames f left join s on s.job_id = f.job_id and s.ref = printf('frame_%06d', f.frame_index))
    select * from n where position in (0, 2, 5, 40)""")
def b6_export_rows(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("ref", frame_ref(F.col("frame_index")))
    shots = f.select("job_id", frame_ref(F.col("frame_index") % 30).alias("ref"), F.col("event_id").alias("note"))
    return L.export_rows(f.select("job_id", "ref", "event_id", "timestamp_ms"), shots, "job_id", "ref", "timestamp_ms", "event_id", "note", [0, 2, 5, 40]).select("job_id", "event_id", "shot.note", F.col("position").cast("long").alias("position"))


@query("""select event_id, event_type in ('click', 'view') and not (case event_id % 4 when 0 then 'a.png' when 1 then '../a.png' when 2 then 'x/y.png' else 'b..png' end like '%..%' or event_id % 4 = 2) as allowed from events""")
def b10_artifacts(spark: SparkSession, d: str) -> DataFrame:
    from quillframe.sources.writers import artifact_allowed

    n = F.col("event_id") % 4
    name = F.when(n == 0, "a.png").when(n == 1, "../a.png").when(n == 2, "x/y.png").otherwise("b..png")
    return table(spark, d, "events").select("event_id", artifact_allowed(F.col("event_type"), name, ["click", "view"]).alias("allowed"))


@query("""select i as position, (i + 1) * 5000 as captured_at_ms, round(0.85 + 0.02 * i, 2) as confidence, ['demographics', 'income', 'household', 'eligibility', 'table', 'policy_guidance'][i + 1] as section_type from range(6) r(i)""")
def a9_demo_sections(spark: SparkSession, d: str) -> DataFrame:
    return readers.demo_sections(spark).select("position", "captured_at_ms", F.round("confidence", 2).alias("confidence"), "section_type")
