"""Spelling correction by an index of deletions.

Words two edits apart (insert, delete, replace, swap neighbours) have a common form with at most two signs deleted from either, so words and
dictionary meet by equality of such forms, and only what meets is measured. Distinct words are looked up, not their occurrences. A known word stays;
else the most frequent dictionary word one edit away is taken, else the most frequent one two edits away (ties: the first by the alphabet), else the word stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.scratch import Scratch
from quillframe.shipping import ship
from quillframe.spread import spread

# Fixed value: signs that are cut from the ends of a word.
ENDS = ".,*!?;:\"'()-"
#: A table of corrections of more words than this is broadcast only where Spark's own threshold, for the bytes of its files, has it so.
BROADCAST_WORDS = 200_000


def word_counts(df: DataFrame, text: str, least: int) -> DataFrame:
    """(word, n): a dictionary counted from a corpus: words of letters that occur `least` times, in lower case."""
    words = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+", -1)).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _shorter(forms: Column) -> Column:
    """All forms with one sign deleted."""
    return F.array_distinct(F.flatten(F.transform(forms, lambda w: F.when(F.char_length(w) > 0, F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))).otherwise(F.array().cast("array<string>")))))


def deletions(word: Column) -> Column:
    """The word and its forms with one or two signs deleted."""
    one = _shorter(F.array(word))
    return F.array_distinct(F.concat(F.array(word), one, _shorter(one)))


def _within_one(a: str, b: str) -> bool:
    """Whether at most one edit is between two words that have not the same last sign."""
    if len(a) == len(b):
        return a[:-1] == b[:-1] or a[:-2] == b[:-2] and a[-2:] == b[:-3:-1]
    return a[:-1] == b or a == b[:-1]


def edits(a: str, b: str) -> int:
    """Fewest inserts, deletes, replaces and swaps of neighbours between two words, 3 standing for more than 2."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > 2:
        return 3
    if a == b:
        return 0
    start = 0
    while start < m and a[start] == b[start]:
        start += 1
    while m > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]  # they differ in the first sign and in the last: one edit is there and one here, or one does both
    m, n = m - start, n - start
    if n == 1 or m == n == 2 and a == b[::-1]:
        return 1
    swapped = a[:2] == b[1::-1]
    if m == n:
        two = _within_one(a[1:], b[1:]) or a[1:] == b[:-1] or a[:-1] == b[1:] or swapped and _within_one(a[2:], b[2:])
    elif n == m + 1:
        two = _within_one(a, b[1:]) or a[1:] == b[1:-1] or swapped and a[2:] == b[2:-1] or m == 2 and a == b[::-2]
    else:
        two = a == b[1:-1]
    return 2 if two else 3


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, correction) of the words (column word, lower case) that the dictionary (word, n) lacks and has a near word for."""
    ship(words.sparkSession)
    unknown = words.select("word").distinct().join(dictionary.select("word"), "word", "left_anti")
    asked = spread(unknown).select("word", F.explode(deletions(F.col("word"))).alias("form"))
    filed = spread(dictionary).select(F.col("word").alias("known"), "n", F.explode(deletions(F.col("word"))).alias("form"))
    # The plan takes the forms for as few bytes as the words, some fifty times too few, and would send them all to the driver; the pairs are short, so they are dealt to all cores by number.
    met = spread(asked.join(filed.hint("merge"), "form").select("word", "known", "n"), "word", "known").distinct()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["far"] = [edits(x, y) for x, y in zip(b["word"], b["known"])]
            yield b[b["far"] <= 2]

    near = met.mapInPandas(measured, "word string, known string, n bigint, far int")
    return near.groupBy("word").agg(F.min_by("known", F.struct("far", (-F.col("n")).alias("less"), F.col("known").alias("tie"))).alias("correction"))


def _bare(part: Column) -> Column:
    return F.btrim(part, F.lit(ENDS))


def corrected(df: DataFrame, text: str, dictionary: DataFrame, out: str = "corrected") -> DataFrame:
    """df with the corrected text: words are cut at white space and bared of ENDS, those of letters that are not all capitals corrected (in lower case), empty ones left out, joined by one blank."""
    tmp = Scratch(df.sparkSession, "corrected")
    dictionary = tmp.keep(dictionary.select("word", "n"), "dictionary")  # asked four times, and a corpus may have to be counted for it
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    parts = rows.select("_row", F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\s+", -1)).alias("_at", "_part")).withColumn("_bare", _bare(F.col("_part"))).filter("_bare != ''")
    wanted = F.col("_bare").rlike(r"^\p{L}+$") & (F.upper("_bare") != F.col("_bare"))
    marked = parts.withColumn("word", F.when(wanted, F.lower("_bare")))
    table = tmp.keep(corrections(marked.filter("word is not null").select("word"), dictionary), "corrections")
    met = marked.join(F.broadcast(table) if table.count() <= BROADCAST_WORDS else table, "word", "left")
    told = F.when(F.col("word").isNull(), F.col("_bare")).otherwise(F.coalesce("correction", "word"))
    joined = met.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", told.alias("w")))), lambda x: x["w"]), " ").alias(out))  # words of one text
    return rows.join(joined, "_row", "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_row")
