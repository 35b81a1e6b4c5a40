"""Operators on the frames of a job, in order of time.

Frames of a job are one group by nature (a recording), so per-job windows and folds are as parallel as there are jobs. All
take the names of the job, time and order columns; ties in time go by the order column. The folds (`sample_adaptive`,
`detect_changes`) stream a job's sorted frames and hold one state; `anchors` and `greedy_distinct` hold a job's times or
hashes, some bytes a frame, in one row, so a job should not have more than some ten million frames there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.shipping import ship

# Limits of the change detector and of the adaptive sampler.
SAME, CHANGE = 0.95, 0.60
BASE, LOW, HIGH = 0.85, 0.80, 0.92
COOLDOWN_MS, HISTORY = 2000, 20
STATIC, DENSE, DENSE_FACTOR = 0.98, 0.93, 0.75

#: likeness(last kept frame, frame), 1 for equal ones.
Likeness = Callable[[Any, Any], float]


def in_order(job: str, ts: str, order: str):
    return Window.partitionBy(job).orderBy(ts, order)


def stability(value: Column, window, scale: float) -> Column:
    """1 - squared difference to the previous frame, on a scale; 0.5 for the first frame."""
    before = F.lag(value).over(window)
    return F.when(before.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - (value - before) * (value - before) / (scale * scale)))


def cross_correlation(a: Column, b: Column) -> Column:
    """Mean-centred normalized correlation of two arrays; 1 if either is flat, 0 if either is null."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    def centred(x: Column) -> Column:
        mean = total(F.transform(x, lambda v: v.cast("double"))) / F.size(x)
        return F.transform(x, lambda v: v.cast("double") - mean)

    da, db = centred(a), centred(b)
    dot = total(F.zip_with(da, db, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(da, lambda v: v * v)) * total(F.transform(db, lambda v: v * v)))
    return F.when(a.isNull() | b.isNull(), 0.0).when(norm < 1e-6, 1.0).otherwise(dot / norm)


def rolling_threshold(similarity: Column, window) -> Column:
    """The change threshold from the last 20 similarities: raised when they vary much, lowered when they hardly vary."""
    recent = window.rowsBetween(-(HISTORY - 1), 0)
    var, n = F.var_pop(similarity).over(recent), F.count(similarity).over(recent)
    return F.when(n < 5, BASE).when(var > 0.02, min(BASE + 0.03, HIGH)).when(var < 0.005, max(BASE - 0.02, LOW)).otherwise(BASE)


def anchors(df: DataFrame, job: str, ts: str, width: int, order: str) -> DataFrame:
    """Adds window_start: a window opens at a job's first frame, and again at each frame `width` or more after the last opening."""
    frames = F.array_sort(F.collect_list(F.struct(ts, order)))
    step = lambda acc, x: F.when(F.size(acc) == 0, F.array(x[ts])).when(x[ts] - F.element_at(acc, -1) >= width, F.concat(acc, F.array(x[ts]))).otherwise(acc)
    kind = df.schema[ts].dataType.simpleString()
    opened = df.groupBy(job).agg(F.aggregate(frames, F.array().cast(f"array<{kind}>"), step).alias("opened"))
    starts = opened.select(job, F.explode("opened").alias("window_start"))
    # As-of join: openings and frames in one ordered stream, each frame taking the last opening.
    mixed = df.withColumns({"_open": F.lit(None).cast(kind), "_at": F.col(ts), "_kind": F.lit(1)}).unionByName(
        starts.select(job, F.col("window_start").alias("_open"), F.col("window_start").alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    last = F.last("_open", ignorenulls=True).over(Window.partitionBy(job).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    return mixed.withColumn("window_start", last).filter("_kind = 1").drop("_open", "_at", "_kind")


def best_per_window(df: DataFrame, job: str, ts: str, score: str, width: int, order: str) -> DataFrame:
    """The best-scored frame of each anchored window; the first wins ties."""
    rank = F.row_number().over(Window.partitionBy(job, "window_start").orderBy(F.col(score).desc(), ts, order))
    return anchors(df, job, ts, width, order).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def sample_gaps(df: DataFrame, job: str, ts: str, interval: int, order: str) -> DataFrame:
    """Keeps a job's first frame and every frame `interval` or more after the last kept one."""
    tagged = anchors(df, job, ts, interval, order)
    first = F.row_number().over(Window.partitionBy(job, "window_start").orderBy(ts, order))
    return tagged.withColumn("_first", first).filter("_first = 1").drop("_first", "window_start")


def consolidate(df: DataFrame, job: str, ts: str, importance: str, width: int, order: str) -> DataFrame:
    """Adds redundant: not the most important frame of its anchored window."""
    rank = F.row_number().over(Window.partitionBy(job, "window_start").orderBy(F.col(importance).desc(), ts, order))
    return anchors(df, job, ts, width, order).withColumn("redundant", rank > 1)


def redundant_with_earlier(df: DataFrame, job: str, order: str, similarity, above: float) -> DataFrame:
    """Adds redundant: more similar than `above` to any earlier frame of the job, redundant or not. similarity(a, b) takes struct columns."""
    pairs = df.select(job, F.struct(*df.columns).alias("b")).join(df.select(F.col(job).alias("_job"), F.struct(*df.columns).alias("a")), (F.col(job) == F.col("_job")) & (F.col("a")[order] < F.col("b")[order]))
    most = pairs.groupBy(job, F.col("b")[order].alias(order)).agg(F.max(similarity(F.col("a"), F.col("b"))).alias("most"))
    return df.join(most, [job, order], "left").withColumn("redundant", F.coalesce(F.col("most") > above, F.lit(False))).drop("most")


def greedy_distinct(df: DataFrame, job: str, score: str, order: str, item: str, similarity, least: float) -> DataFrame:
    """Best first, keeps a frame unless it is `least` or more similar to a kept one. similarity(a, b) takes item columns."""
    kind = df.schema[item].dataType.simpleString()
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("less"), F.col(order).alias("order"), F.col(item).alias("item"))))
    state = f"array<struct<order:{df.schema[order].dataType.simpleString()},item:{kind}>>"

    def keep(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: similarity(k["item"], x["item"]) >= least)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(F.struct(x["order"].alias("order"), x["item"].alias("item")))))

    kept = df.groupBy(job).agg(F.aggregate(rows, F.array().cast(state), keep).alias("kept"))
    return df.join(kept.select(job, F.explode("kept.order").alias(order)), [job, order], "left_semi")


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits


def sign_hash(vector: Column) -> Column:
    """Bits of an average hash over the first 64 values: above their mean or not."""
    part = F.transform(F.slice(vector, 1, 64), lambda v: v.cast("double"))
    mean = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / F.size(part)
    bits = F.lit(0).cast("long")
    for i in range(64):
        one = (1 << i) - (1 << 64 if i == 63 else 0)
        bits = bits.bitwiseOR(F.when(F.get(part, F.lit(i)) > mean, F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def scalar_likeness(scale: float) -> Likeness:
    """For frames that are described by one number."""
    return lambda a, b: max(0.0, 1 - abs(b - a) / scale)


def missing(frame: Any) -> bool:
    return frame is None or (isinstance(frame, float) and frame != frame)


def change_step(state: dict | None, ts: int, frame: Any, first: Likeness, second: Likeness | None = None) -> tuple[dict, float, bool]:
    """One frame of the change detector: (state, score, is_change). State: last kept frame and time, recent likenesses.

    The first frame is a change. A frame is compared with the last kept one. First pass: over 0.95 it is the same, below 0.60 it
    changed. Between them the second, more precise likeness (that of the first pass if there is none) is below the threshold or
    not; the threshold follows the variance of recent first-pass likenesses. A change within two seconds of the last kept frame is
    not one. An unreadable frame (null) leaves the state alone.
    """
    if missing(frame):
        return state or {}, 0.0, False
    if not state:
        return {"frame": frame, "ts": ts, "recent": []}, 1.0, True
    likeness = first(state["frame"], frame)
    recent = [*state["recent"], likeness][-HISTORY:]
    changed = likeness < CHANGE
    if CHANGE <= likeness <= SAME:
        limit = BASE
        if len(recent) >= 5:
            mean = sum(recent) / len(recent)
            var = sum((x - mean) ** 2 for x in recent) / len(recent)
            limit = min(BASE + 0.03, HIGH) if var > 0.02 else max(BASE - 0.02, LOW) if var < 0.005 else BASE
        likeness = second(state["frame"], frame) if second else likeness
        changed = likeness < limit
    changed = changed and ts - state["ts"] >= COOLDOWN_MS
    new = {"frame": frame, "ts": ts, "recent": recent} if changed else state | {"recent": recent}
    return new, round(max(0.0, 1 - likeness), 4), changed


def sample_step(state: dict | None, ts: float, frame: Any, likeness: Likeness, interval: float) -> tuple[dict, bool]:
    """One frame of the adaptive sampler: (state, kept). State: last kept frame, next time to look.

    The first frame is kept. A frame before the next time is passed over. One that is over 0.98 like the last kept frame is
    passed over too, and the next look is an interval later. Others are kept; the next look follows after an interval, or
    after 0.75 of one where the likeness is below 0.93. An unreadable frame (null) is like no other.
    """
    if not state:
        return {"frame": frame, "next": ts + interval}, True
    if ts < state["next"]:
        return state, False
    alike = 0.0 if missing(frame) or missing(state["frame"]) else likeness(state["frame"], frame)
    if alike > STATIC:
        return state | {"next": ts + interval}, False
    return {"frame": frame, "next": ts + (interval * DENSE_FACTOR if alike < DENSE else interval)}, True


def folded(df: DataFrame, job: str, ts: str, order: str, step: Callable[[Any, dict], tuple[Any, dict | None]], added: list[T.StructField]) -> DataFrame:
    """Folds step(state, row) -> (state, new columns, or None to drop the row) over each job's rows in order.

    Jobs are sorted inside their partitions and streamed batch by batch, so that a job may be of any length; one state is held.
    """
    ship(df.sparkSession)
    same = lambda a, b: a == b or (missing(a) and missing(b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            kept, out = [], []
            for i, row in enumerate(b.to_dict("records")):
                if not same(at, row[job]):
                    at, state = row[job], None
                state, new = step(state, row)
                if new is not None:
                    kept.append(i)
                    out.append(new)
            yield b.iloc[kept].reset_index(drop=True).assign(**{f.name: [x[f.name] for x in out] for f in added})

    return df.repartition(job).sortWithinPartitions(job, ts, order).mapInPandas(run, T.StructType([*df.schema.fields, *added]))


def detect_changes(df: DataFrame, job: str, ts: str, frame: str, order: str, first: Likeness, second: Likeness | None = None) -> DataFrame:
    """Adds score and is_change by folding change_step over each job's frames (the state is the last kept frame, so no window does it)."""
    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        state, score, changed = change_step(state, int(row[ts]), row[frame], first, second)
        return state, {"score": score, "is_change": changed}

    return folded(df, job, ts, order, step, [T.StructField("score", T.DoubleType()), T.StructField("is_change", T.BooleanType())])


def sample_adaptive(df: DataFrame, job: str, ts: str, frame: str, order: str, interval: float, likeness: Likeness) -> DataFrame:
    """The frames that the adaptive sampler keeps, by folding sample_step over each job."""
    def step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        state, kept = sample_step(state, float(row[ts]), row[frame], likeness, interval)
        return state, {} if kept else None

    return folded(df, job, ts, order, step, [])


def ticks(duration_ms: Column) -> Column:
    """Ruler marks in seconds: every 5, 15, 30 or 60, by length."""
    s = duration_ms / 1000
    step = F.when(s <= 30, 5).when(s <= 120, 15).when(s <= 300, 30).otherwise(60)
    return F.sequence(F.lit(0), F.floor(s).cast("int"), step)


def nearest(df: DataFrame, job: str, ts: str, at: Column, order: str) -> DataFrame:
    """The frame nearest to a time per job; the earlier row wins ties."""
    return df.groupBy(job).agg(F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(ts) - at), F.col(order))).alias("frame")).select("frame.*")


