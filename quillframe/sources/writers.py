"""Sinks: partitioned tables, reports, exports, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import minutes

# Titles of the report's sections by bucket.
TITLES = {1: "Case List", 2: "Program Eligibility", 3: "Eligibility Evidence", 4: "State Eligibility Determination", 5: "Unknown"}


def append(df: DataFrame, path: str, by: str = "job_id") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def replace_jobs(df: DataFrame, path: str, by: str = "job_id") -> None:
    """Overwrites only the partitions that df has: a job's rows are replaced as one."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_lines(df: DataFrame, columns: list[str], order: list[str], key: str) -> DataFrame:
    return df.select(key, *order, F.to_json(F.struct(*columns)).alias("json"))


def text_export(df: DataFrame, key: str, order: str, heading: str, text: str, rows: str | None = None) -> DataFrame:
    """(key, text): sections in order; table cells are joined by ' | '."""
    body = F.concat(F.lit("== "), F.col(heading), F.lit(" ==\n"), F.col(text))
    if rows:
        table = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
        body = F.concat(body, F.when(F.size(rows) > 0, F.concat(F.lit("\n"), table)).otherwise(""))
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def html_report(sections: DataFrame, jobs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, html): a job's header and its five bucket cards; sections has bucket, heading and summary, jobs a title."""
    item = F.concat(F.lit("<li><b>"), escaped(F.col("heading")), F.lit("</b> "), escaped(F.col("summary")), F.lit("</li>"))
    lists = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", F.col(order).alias("o"), item.alias("li")))).alias("items"))
    joined = jobs.join(lists, key, "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<bucket:int,o:bigint,li:string>>")))

    def card(n: int, title: str) -> Column:
        own = F.transform(F.filter("items", lambda x: x["bucket"] == n), lambda x: x["li"])
        return F.concat(F.lit(f"<section><h2>{n}. {title}</h2><ul>"), F.array_join(own, ""), F.lit("</ul></section>"))

    cards = [card(n, title) for n, title in TITLES.items()]
    title = F.when(F.coalesce("title", F.lit("")) == "", "not provided").otherwise(escaped(F.col("title")))
    return joined.select(key, F.concat(F.lit("<html><body><h1>"), title, F.lit("</h1>"), *cards, F.lit("<footer>"), F.size("items").cast("string"), F.lit(" items</footer></body></html>")).alias("html"))


# The fields of the report's header with their labels, and the media types of its images.
HEADER = {"perm_id": "PERM ID", "recipient": "Recipient", "date_of_service": "Date of Service", "state": "State", "case_type": "Case Type", "sample": "Sample"}
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def header_cells(columns: list[str]) -> Column:
    """The six fields of a job; empty and missing ones are not provided."""
    def cell(name: str, label: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")
        return F.concat(F.lit(f"<div><b>{label}</b> "), F.when(value.isin("", "—"), "not provided").otherwise(escaped(value)), F.lit("</div>"))

    return F.concat(*[cell(*x) for x in HEADER.items()])


def image_tag(image: Column, name: Column) -> Column:
    """A capture's image inside the page, by its bytes and file name; what it says where there is none."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    media = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), kind), F.lit("image/png"))
    return F.when(F.coalesce(name, F.lit("")) == "", "<p>No screenshot recorded</p>").when(image.isNull(), "<p>Image not available</p>").otherwise(F.concat(F.lit('<img src="data:'), media, F.lit(";base64,"), F.base64(image), F.lit('">')))


def capture_report(captures: DataFrame, jobs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, html): the six header fields of each job, then its captures by bucket: image, time, heading, summary, key points, notes.

    captures: key, order, bucket, image (bytes), image_path, captured_at_ms, heading, summary, key_points, notes. All captures of a job are one page, so a page must fit a row.
    """
    points = F.array_join(F.transform(F.coalesce("key_points", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "")
    shown = lambda c: escaped(F.coalesce(F.col(c), F.lit("")))
    item = F.concat(F.lit("<article>"), image_tag(F.col("image"), F.col("image_path")), F.lit("<p>Captured at "), minutes(F.coalesce("captured_at_ms", F.lit(0))), F.lit("</p><h3>"), shown("heading"), F.lit("</h3><p>"), shown("summary"),
                    F.lit("</p><ul>"), points, F.lit("</ul><p>"), shown("notes"), F.lit("</p></article>"))
    listed = captures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", F.col(order).alias("o"), item.alias("h")))).alias("items"))
    met = jobs.join(listed, key, "left")

    def section(n: int, title: str) -> Column:
        own = F.transform(F.filter("items", lambda x: x["bucket"] == n), lambda x: x["h"])
        return F.concat(F.lit(f"<section><h2>{n}. {title}</h2>"), F.coalesce(F.array_join(own, ""), F.lit("")), F.lit("</section>"))

    return met.select(key, F.concat(F.lit("<html><body><header>"), header_cells(jobs.columns), F.lit("</header>"), *[section(*x) for x in TITLES.items()], F.lit("</body></html>")).alias("html"))


def artifact_allowed(kind: Column, name: Column, kinds: list[str]) -> Column:
    """Whether an artifact may be read: a known kind and a plain file name."""
    return kind.isin(kinds) & ~name.rlike(r"\.\.|/|\\")
