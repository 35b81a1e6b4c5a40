"""Exact token-length histogram with suffix sums.

Texts are encoded where they lie; each Arrow batch sends one row per distinct length. Suffix sums are taken in two
levels (inside blocks of 1,024 lengths and over the blocks), so that no task meets more lengths than a block or the
list of blocks has, whatever the longest document.

Defined results: a null text counts as empty (length 0); rows with null or repeated ids count like any other. An empty
table gives an empty histogram. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, ship
from .tokens import default_tokenizer, encoder

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, docs): the exact histogram."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            seen = Counter(len(encode(x.as_py() or "")) for x in b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "docs"])
        give_back()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length bigint, docs bigint")
    return parts.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame, limits: list[int] | None = None) -> DataFrame:
    """For each length, and each of `limits`, as a context limit: what is longer, what is cut, and the total after truncation.

    quantile is the share of documents that fit into the limit. A limit that no document has for its length is a length of no
    documents. Over an empty histogram the limits have no totals, and nothing is returned.
    """
    spark = hist.sparkSession
    hist = Scratch(spark, "token-counts").keep(hist, "hist")  # it is read several times, encoded once
    if limits:
        asked = spark.createDataFrame([(int(x), 0) for x in set(limits)], "length bigint, docs bigint")
        hist = hist.unionByName(asked).groupBy("length").agg(F.sum("docs").alias("docs"))
    base = hist.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = base.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d_later"), F.coalesce(F.sum("t").over(later), zero).alias("t_later"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    got = base.select("*", F.coalesce(F.sum("docs").over(inside), zero).alias("d_in"), F.coalesce(F.sum("tokens").over(inside), zero).alias("t_in")).join(blocks, "block")
    longer, tokens = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return got.filter("d_all > 0").select(
        "length", "docs", "tokens", longer.alias("docs_longer"), tokens.alias("tokens_longer"), F.col("d_all").alias("docs_all"), F.col("t_all").alias("tokens_all"),
        (F.col("t_all") - tokens + longer * F.col("length")).alias("truncated_tokens"), ((F.col("d_all") - longer) / F.col("d_all")).alias("quantile"),
    )
