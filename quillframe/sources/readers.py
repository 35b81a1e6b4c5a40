"""Sources: tables, labelled corpora, side-car files, recognised words, uploads. All are Spark readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "webm"]
UPLOAD_EXTENSIONS = ["png", "jpg", "jpeg", "pdf", "tif", "tiff", "bmp"]
VIDEO_BYTES, UPLOAD_BYTES = 2 * 1024**3, 50 * 1024**2


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, content) of files; content is read only where a query uses it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_error(path: Column, length: Column, extensions: list[str], most: int) -> Column:
    """Why a file isn't accepted; null if it is."""
    return (
        F.when(path.isNull() | (path == ""), "no path").when(~extension(path).isin(extensions), F.concat(F.lit("unsupported extension: "), extension(path)))
        .when(length.isNull(), "not found").when(length == 0, "empty file").when(length > most, "too large")
    )


def duration_ms(frames: Column, fps: Column, end_ms: Column) -> Column:
    """Length of a recording: frames over rate, or the last position where that can't be (no length, or a rate of 500 and more)."""
    by_rate = F.when(fps > 0, frames / fps * 1000)
    return F.when((fps >= 500) | by_rate.isNull() | (by_rate <= 0), end_ms).otherwise(by_rate)


def sniff(content: Column) -> Column:
    """The kind of a file from its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tif").when(head.startswith("424D"), "bmp")


def labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV with text, label and three numbers; blank numbers are 0, labels are trimmed."""
    schema = "filename string, label string, text string, table_row_count int, table_text_ratio double, avg_cells_per_row double"
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("table_row_count", "table_text_ratio", "avg_cells_per_row")}
    return df.withColumns({"label": F.trim("label"), **zero})


def crops(spark: SparkSession, path: str) -> DataFrame:
    """job_id (the folder that a side-car lies in), x, y, w, h of crop side-cars; only those with all four keys. A side-car is one JSON value, whatever its lines."""
    read = spark.read.schema("x int, y int, w int, h int").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    job = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return read.select(job.alias("job_id"), "x", "y", "w", "h").dropna(subset=["x", "y", "w", "h"])


def cropped(jobs: DataFrame, side_cars: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs with their crop, null where they have none; of several side-cars of a job one by order of their values."""
    one = side_cars.groupBy("job_id").agg(F.min(F.struct("x", "y", "w", "h")).alias("crop")).withColumnRenamed("job_id", job)
    return jobs.join(one, job, "left")


def recognised_words(df: DataFrame, key: str, tsv: str) -> DataFrame:
    """Rows of recogniser TSV texts, by header; lines with another number of cells go."""
    lines = F.split(F.regexp_replace(F.col(tsv), r"\r", ""), "\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    rows = df.select(key, head.alias("head"), F.posexplode(F.slice(lines, 2, 1_000_000_000)).alias("ord", "line")).withColumn("cells", F.split("line", "\t", -1)).filter(F.size("cells") == F.size("head"))
    m = F.map_from_arrays("head", "cells")
    named = rows.select(key, "ord", m.alias("m"))
    get = lambda c, kind: F.element_at("m", F.lit(c)).try_cast(kind)
    return named.select(key, "ord", get("block_num", "int").alias("block"), get("par_num", "int").alias("par"), get("line_num", "int").alias("line"), get("left", "int").alias("x"), get("top", "int").alias("y"), get("width", "int").alias("w"), get("height", "int").alias("h"), get("conf", "double").cast("int").alias("conf"), F.element_at("m", F.lit("text")).alias("text"))


def migrated(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with the columns that a newer schema added, null where it has none."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def demo_sections(spark: SparkSession) -> DataFrame:
    """Six invented sections, five seconds apart, for demonstrations."""
    texts = [
        ("demographics", "APPLICANT DETAILS\nName: Ana Perez\nDate of Birth: 04/12/1988\nPhone: 555-010-2233"), ("income", "Employer: Harbor Foods\nMonthly income: $2,150.00\nHours: 38"),
        ("household", "1. Ana Perez\n2. Luis Perez\n3. Mia Perez"), ("eligibility", "DETERMINATION\nStatus | Approved\nEffective Date: 01/05/2025"),
        ("table", "Month | Amount\nMay | $210.00\nJune | $215.00"), ("policy_guidance", "GUIDANCE\n- report changes within ten days\n- keep receipts"),
    ]
    rows = [(i, kind, (i + 1) * 5000, 0.85 + 0.02 * i, text) for i, (kind, text) in enumerate(texts)]
    return spark.createDataFrame(rows, "position bigint, section_type string, captured_at_ms bigint, confidence double, extracted_text string")
