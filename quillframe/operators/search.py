"""Text search, roll-ups, frame metrics, titles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import rules
from quillframe.scratch import Scratch
from quillframe.shipping import ship


def match_count(text: Column, query: str) -> Column:
    """Occurrences, not overlapping, of a query in the lower-cased text."""
    low = F.lower(text)
    return F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit(query)))) / F.lit(len(query))).cast("int")


def search(sources: list[tuple[DataFrame, str]], query: str, ref: str, text: str, order: str) -> DataFrame:
    """Rows of several sources whose text has the query: a reference found in an earlier source is not shown again; best count first.

    sources: (table with ref, text and order columns, name). The query is trimmed and lower-cased. A reference whose text in
    an earlier source lacks the query hides nothing.
    """
    q = query.strip().lower()
    found, seen = None, None
    for rank, (df, name) in enumerate(sources):
        hits = df.select(ref, text, order).filter(F.contains(F.lower(text), F.lit(q)))
        own = hits.select(ref)
        hits = hits if seen is None else hits.join(seen, ref, "left_anti")
        hits = hits.select(ref, text, order, F.lit(name).alias("source"), F.lit(rank).alias("rank"), match_count(F.col(text), q).alias("match_count"))
        found = hits if found is None else found.unionByName(hits)
        seen = own if seen is None else seen.unionByName(own)
    return found.orderBy(F.col("match_count").desc(), "rank", order).drop("rank")


def roll_up(items: DataFrame, kind: str, value: str, frame: str) -> DataFrame:
    """Per type and text: how often and in how many frames; and the type's total."""
    each = items.groupBy(kind, value).agg(F.count("*").alias("n"), F.count_distinct(frame).alias("frames"), F.min(frame).alias("first_frame"))
    return each.withColumn("type_total", F.sum("n").over(Window.partitionBy(kind)))


def entity_frames(items: DataFrame, kind: str, value: str, frame: str, like: str | None = None) -> DataFrame:
    """Per type and text that has `like` in it (any case): how often, its frames in order, the type's distinct texts that match and its total of all texts.

    Frames are told apart before they are gathered, so an entity's list is no longer than its job has frames.
    """
    counts = items.groupBy(kind, value, frame).agg(F.count("*").alias("n"))
    each = counts.groupBy(kind, value).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(frame)).alias("frames"))
    whole = each.withColumn("type_total", F.sum("n").over(Window.partitionBy(kind)))
    kept = whole.filter(F.contains(F.lower(value), F.lit(like.lower()))) if like else whole
    return kept.withColumn("type_unique", F.count("*").over(Window.partitionBy(kind)))


def density(length: Column, entities: Column, confidence: Column) -> Column:
    return length * F.greatest(entities, F.lit(1)) * F.greatest(confidence / 100, F.lit(0.1))


def data_rich(tables: Column, pairs: Column, lists: Column, boxes: Column, fields: Column) -> Column:
    return 10 * tables + 3 * pairs + 2 * lists + boxes + fields


def entity_diverse(categories: Column) -> Column:
    """How many types of a map from type to texts have any."""
    return F.size(F.filter(F.map_values(categories), lambda texts: F.size(texts) > 0))


def chip_counts(df: DataFrame, group: list[str], categories: str) -> DataFrame:
    """Per group and type of a map from type to texts: how many texts, empty types included."""
    each = df.select(*group, F.explode(categories).alias("type", "texts"))
    return each.groupBy(*group, "type").agg(F.sum(F.size("texts")).alias("total"))


def distinct_texts(categories: Column) -> Column:
    """The map with each type's texts once, in order of first sight."""
    return F.transform_values(categories, lambda _, texts: F.array_distinct(texts))


def run_summary(text: Column, categories: Column, tables: Column, confidence: Column, strategy: Column) -> Column:
    """What is told of a recognised frame: text_length, entity_count, table_count, confidence, strategy."""
    entities = F.aggregate(F.map_values(categories), F.lit(0), lambda n, texts: n + F.size(texts))
    return F.struct(F.coalesce(F.char_length(text), F.lit(0)).alias("text_length"), entities.alias("entity_count"), tables.alias("table_count"), confidence.alias("confidence"), strategy.alias("strategy"))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: F.char_length(w) > 2))


def _alike_by_words(classes: DataFrame) -> DataFrame:
    """(job, rep, similar) of jobs of one chunk, by a join on (job, word): classes without a common word never meet."""
    words = classes.select("job", "rep", "size", F.explode("set").alias("word"))
    other = classes.select("job", F.col("rep").alias("_rep"), F.col("size").alias("_size"), "m", F.explode("set").alias("word"))
    shared = words.join(other, ["job", "word"]).filter(F.col("rep") != F.col("_rep")).groupBy("job", "rep", "_rep").agg(F.count("*").alias("both"), F.first("size").alias("size"), F.first("_size").alias("_size"), F.first("m").alias("m"))
    return shared.groupBy("job", "rep").agg(F.sum(F.col("m") * F.col("both") / (F.col("size") + F.col("_size") - F.col("both"))).alias("similar"))


def _common_words(left: list, right: list, width: int = 4096) -> np.ndarray:
    """How many words each left set has in common with each right set: products of indicator matrices, `width` words at a time."""
    codes, _ = pd.factorize(np.concatenate([*left, *right]))
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    at = len(rows[0])
    shared, both = np.intersect1d(codes[:at], codes[at:]), np.zeros((len(left), len(right)))
    for lo in range(0, len(shared), width):
        some = shared[lo : lo + width]
        sides = []
        for side, row, code in ((left, rows[0], codes[:at]), (right, rows[1], codes[at:])):
            place = np.searchsorted(some, code).clip(max=len(some) - 1)
            hit = some[place] == code
            has = np.zeros((len(side), len(some)), "float32")
            has[row[hit], place[hit]] = 1
            sides.append(has)
        both += sides[0] @ sides[1].T
    return both


def _alike_by_chunks(classes: DataFrame) -> DataFrame:
    """(job, rep, similar) of jobs of several chunks: each two chunks meet once and only sums per class leave the task, however common a word is."""
    ship(classes.sparkSession)
    filed = classes.groupBy("job", "chunk", "chunks").agg(F.collect_list(F.struct("rep", "m", "set")).alias("x"))
    told = lambda side: [F.col(f"x.{c}").alias(f"{side}_{c}") for c in ("rep", "m", "set")]
    left = filed.select("job", F.col("chunk").alias("mine"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("its"), *told("a"))
    met = left.join(filed.select("job", F.col("chunk").alias("its"), *told("b")), ["job", "its"]).select("job", "mine", "its", "a_rep", "a_m", "a_set", "b_rep", "b_m", "b_set")

    def sums(batches):
        for batch in batches:
            parts = []
            for job, mine, its, a_rep, a_m, a_set, b_rep, b_m, b_set in batch.itertuples(index=False):
                both = _common_words(list(a_set), list(b_set))
                alike = both / (np.array([len(x) for x in a_set])[:, None] + np.array([len(x) for x in b_set])[None, :] - both)
                if mine == its:
                    alike[np.asarray(a_rep)[:, None] == np.asarray(b_rep)[None, :]] = 0
                else:
                    parts.append(pd.DataFrame({"job": [job] * len(b_rep), "rep": b_rep, "similar": np.asarray(a_m) @ alike}))
                parts.append(pd.DataFrame({"job": [job] * len(a_rep), "rep": a_rep, "similar": alike @ np.asarray(b_m)}))
            if parts:
                yield pd.concat(parts)

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return met.mapInPandas(sums, f"job {kinds['job']}, rep {kinds['rep']}, similar double").groupBy("job", "rep").agg(F.sum("similar").alias("similar"))


def unique_content(df: DataFrame, job: str, frame: str, text: str, sets: int = 512, words: int = 50_000) -> DataFrame:
    """(1 - mean Jaccard with the job's other frames that have words) * distinct words. job (not null) and frame, numbers or strings, name a row.

    Frames with the same words are one class. Jobs of at most `sets` classes and `words` words meet by word; larger ones are dealt into chunks of
    about that size that meet chunk by chunk, so a word in all frames costs no rows.
    """
    named = df.select(F.col(job).alias("job"), F.col(frame).alias("frame"), F.array_sort(word_set(F.col(text))).alias("set")).withColumn("size", F.size("set"))
    folded = named.filter("size > 0").groupBy("job", "set").agg(F.count("*").alias("m"), F.min("frame").alias("rep"), F.first("size").alias("size"))
    chunks = F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("size") / words)).cast("int")
    each = folded.groupBy("job").agg(chunks.alias("chunks"), F.sum("m").alias("filled"))
    classes = Scratch(df.sparkSession, "unique-content").keep(folded.join(each, "job").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")), "classes")
    large = classes.filter("chunks > 1")
    alike = _alike_by_words(classes.filter("chunks = 1"))
    alike = alike if large.isEmpty() else alike.unionByName(_alike_by_chunks(large))
    summed = classes.join(alike, ["job", "rep"], "left").select("job", "set", "filled", (F.coalesce("similar", F.lit(0.0)) + F.col("m") - 1).alias("similar"))
    mean = F.when(F.col("filled") > 1, F.col("similar") / (F.col("filled") - 1)).otherwise(0.0)
    told = named.join(summed, ["job", "set"], "left")
    return told.select(F.col("job").alias(job), F.col("frame").alias(frame), "size", F.when(F.col("size") > 0, (1 - mean) * F.col("size")).otherwise(0.0).alias("unique_content"))


def top_half(df: DataFrame, job: str, score: str, order: str) -> DataFrame:
    """The better half, rounded up, of a job's rows with a positive score; at least one."""
    positive = df.filter(F.col(score) > 0)
    w = Window.partitionBy(job)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), order))
    return positive.withColumns({"_rank": rank, "_n": n}).filter(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.5))).drop("_rank", "_n")


def title_words(df: DataFrame, job: str, text: str, order: str, stop: list[str] = rules.TITLE_STOP_WORDS, frames: int = 5, most: int = 5, among: int = 50) -> DataFrame:
    """(job, title): the commonest words of the first frames with text among a job's first 50; ties by first occurrence; over 60 characters cut."""
    early = df.withColumn("_e", F.row_number().over(Window.partitionBy(job).orderBy(order))).filter(F.col("_e") <= among).drop("_e")
    with_text = early.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    first = with_text.withColumn("_f", F.row_number().over(Window.partitionBy(job).orderBy(order))).filter(F.col("_f") <= frames)
    words = first.select(job, "_f", F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("_p", "word")).withColumn("word", F.lower("word")).filter(~F.col("word").isin(stop))
    counted = words.groupBy(job, "word").agg(F.count("*").alias("n"), F.min(F.struct("_f", "_p")).alias("first"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy(job).orderBy(F.col("n").desc(), "first"))).filter(F.col("_r") <= most)
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.initcap("word").alias("w")))), lambda x: x["w"]), " ")
    named = best.groupBy(job).agg(title.alias("title"))
    return named.withColumn("title", F.when(F.char_length("title") > 60, F.concat(F.left("title", F.lit(57)), F.lit("..."))).otherwise(F.col("title")))


def merge_runs(df: DataFrame, job: str, order: str, sums: list[str], text: str, lists: list[str] | None = None) -> DataFrame:
    """Runs of a job as one: summed counts, joined texts and flattened lists in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text, *(lists or []))))
    merged = df.groupBy(job).agg(*[F.sum(c).alias(c) for c in sums], ordered.alias("_runs"))
    merged = merged.withColumn(text, F.array_join(F.transform("_runs", lambda x: x[text]), "\n\n"))
    return merged.withColumns({c: F.flatten(F.col("_runs")[c]) for c in lists or []}).drop("_runs")
