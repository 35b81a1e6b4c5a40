"""Filters, ordered look-ups and the joins of frames, screenshots and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import frame_ref


def frames_of(frames: DataFrame, least_relevance: float = 0.0, limit: int | None = 500, ts: str = "timestamp_ms", order: str = "frame_index") -> DataFrame:
    """Frames at or over a relevance in order of time, at most `limit` (None: all)."""
    found = frames.filter(F.col("relevance_score") >= least_relevance).orderBy(ts, order)
    return found if limit is None else found.limit(limit)


def screenshots_of(shots: DataFrame, section_type: str | None = None, accepted_only: bool = False) -> DataFrame:
    if section_type is not None:
        shots = shots.filter(F.col("section_type") == section_type)
    if accepted_only:
        shots = shots.filter("accepted")
    return shots.orderBy("order_index", "captured_at_ms")


def in_order(df: DataFrame, job: str, order: list, position: str = "position") -> DataFrame:
    """Rows of each job numbered from 1 in the given order (sections by final order)."""
    return df.withColumn(position, F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def newest_first(df: DataFrame, at: str, tie: str, tie_up: bool = True) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(tie) if tie_up else F.col(tie).desc())


def results(df: DataFrame, job_id=None, frame_id=None, limit: int = 100, most: int = 500, at: str = "created_at", tie: str = "id") -> DataFrame:
    """Classification results, newest first, of a job, of a frame, of both or of all; `most` rows at most."""
    for column, wanted in (("job_id", job_id), ("frame_id", frame_id)):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return newest_first(df, at, tie, tie_up=False).limit(min(limit, most))


def decoded(text: Column, schema: str = "array<string>") -> Column:
    """A JSON text as a value; null where it is none."""
    return F.from_json(text, schema)


def shown_of_total(df: DataFrame, job: str, confidence: str, least: float) -> DataFrame:
    """Per job, how many of how many rows a confidence threshold shows; 0 shows all, also those without a confidence."""
    shown = F.lit(True) if least == 0 else F.coalesce(F.col(confidence) >= least, F.lit(False))
    return df.groupBy(job).agg(F.count_if(shown).alias("shown"), F.count("*").alias("total"))


def with_last(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """left with the last matching row of right as a struct `last`, null where there is none."""
    cols = [c for c in right.columns if c != on]
    return left.join(right.groupBy(on).agg(F.max_by(F.struct(*cols), F.col(order)).alias("last")), on, "left")


def newest(df: DataFrame, key: str | list[str], at: str, tie: str) -> DataFrame:
    """The newest row per key; the larger tie value wins."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(at, tie)).alias("_row")).select(*keys, "_row.*")


def redundant_in_list(score: Column, index: Column) -> Column:
    """What the frame list shows as redundant: no score and not the first frame."""
    return (score == 0) & (index > 0)


def shown_confidence(ocr: Column, score: Column) -> Column:
    """The OCR confidence on a scale to 1, the candidate score where there is none."""
    return F.when(ocr > 1, ocr / 100).when(ocr > 0, ocr).otherwise(score)


def left_by_ref(shots: DataFrame, frames: DataFrame, job: str, index: str, ref: str, order: str) -> DataFrame:
    """Screenshots with their frames, matched by job and derived reference; of frames with one index the last row counts."""
    cols = [c for c in frames.columns if c != job]
    last = frames.withColumn("_ref", frame_ref(F.col(index))).groupBy(job, "_ref").agg(F.max_by(F.struct(*cols), F.col(order)).alias("frame"))
    return shots.join(last.withColumnRenamed("_ref", ref), [job, ref], "left")


def first_or_default(left: DataFrame, right: DataFrame, key: str, order: str, defaults: dict[str, Column]) -> DataFrame:
    """left with the first matching row of right (by order), computed defaults where there is none."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*defaults), F.col(order)).alias("_first"))
    joined = left.join(first, key, "left")
    return joined.withColumns({c: F.coalesce(F.col("_first")[c], d) for c, d in defaults.items()}).drop("_first")


def not_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti")


def already_in(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def by_position(left: DataFrame, right: DataFrame, job: str, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of one table with the i-th of the other, per job, as far as both go."""
    number = lambda df, order: df.withColumn("_at", F.row_number().over(Window.partitionBy(job).orderBy(order)))
    return number(left, left_order).join(number(right, right_order), [job, "_at"]).drop("_at")


def match_files(docs: DataFrame, files: DataFrame, name: str, doc_order: str, file_order: str, job: str) -> DataFrame:
    """Each document takes the next unused file of its name; those left over take the files left over, in order; then none."""
    nth = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(job, name).orderBy(order)))
    d, f = nth(docs, doc_order), nth(files, file_order)
    named = d.join(f, [job, name, "_n"]).select(job, doc_order, file_order)
    order = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy(by)))
    rest_d = order(docs.join(named.select(job, doc_order), [job, doc_order], "left_anti"), doc_order)
    rest_f = order(files.join(named.select(job, file_order), [job, file_order], "left_anti"), file_order).select(job, "_n", file_order)
    return named.unionByName(rest_d.join(rest_f, [job, "_n"], "left").select(job, doc_order, file_order))


def in_first_box(words: DataFrame, boxes: DataFrame, image: str) -> DataFrame:
    """Words (image, ord, x, y, text, conf) in the first box (image, box, x, y, w, h) that holds their corner, edges included.

    Returns box, its words joined by blanks in order and the highest confidence; images are the unit of the range join.
    """
    b = boxes.select(image, F.col("box"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    inside = (F.col("x") >= F.col("bx")) & (F.col("x") <= F.col("bx") + F.col("bw")) & (F.col("y") >= F.col("by")) & (F.col("y") <= F.col("by") + F.col("bh"))
    first = words.join(b, image).filter(inside).groupBy(image, "ord", "text", "conf").agg(F.min("box").alias("box"))
    return first.groupBy(image, "box").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), (F.max("conf") / 100).alias("confidence"))


def overlaps(a: Column, b: Column) -> Column:
    """Shared area of two boxes (x, y, w, h)."""
    side = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def update(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition with changed columns, the others as they are."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_cascade(tables: dict[str, DataFrame], jobs: DataFrame, job: str = "job_id") -> dict[str, DataFrame]:
    """All tables of a job store without the given jobs."""
    return {name: df.join(jobs.select(job), job, "left_anti") for name, df in tables.items()}


def add_manual_frame(frames: DataFrame, job: Column, ms: Column, jobs: DataFrame, key: str = "job_id", index: str = "frame_index", ts: str = "timestamp_ms", first: int = 100_000) -> DataFrame:
    """frames and one hand-picked frame per row of jobs, numbered from 100000 by how many the job has; other columns are null."""
    manual = frames.filter(F.col(index) >= first).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    new = jobs.select(job.alias("_k"), ms.alias(ts)).join(manual, "_k", "left")
    new = new.select(F.col("_k").alias(key), (F.lit(first) + F.coalesce("_n", F.lit(0))).cast(frames.schema[index].dataType).alias(index), ts)
    return frames.unionByName(new, allowMissingColumns=True)


def export_rows(frames: DataFrame, shots: DataFrame, key: str, ref: str, ts: str, order: str, shot_order: str, positions: list[int] | None = None) -> DataFrame:
    """Frames in order of time with their last screenshot, numbered per job from 0; only the given positions, if any."""
    cols = [c for c in shots.columns if c not in (key, ref)]
    last = shots.groupBy(key, ref).agg(F.max_by(F.struct(*cols), F.col(shot_order)).alias("shot"))
    numbered = frames.join(last, [key, ref], "left").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(ts, order)) - 1)
    return numbered if positions is None else numbered.filter(F.col("position").isin(positions))
