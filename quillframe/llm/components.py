"""Connected components by alternating large-star and small-star steps; every step is two aggregations and two joins.

Edges stay distributed and each round is written to the shared folder, so the lineage is one round long. Minima are
combined map-side before the shuffle; the joins put the edges, whose node may be hot, on the side that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge, the smallest node that it reaches. Self loops and repeats are ignored."""
    tmp = Scratch(edges.sparkSession, "components")
    cur = tmp.keep(edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).filter("big > small").distinct(), "round0")
    mark, n = _mark(cur), 0
    while mark[0]:
        lower = cur.groupBy(F.col("big").alias("small")).agg(F.min("small").alias("least"))
        large = cur.join(lower, "small", "left").select("big", F.coalesce("least", "small").alias("small")).distinct()
        large = tmp.keep(large, f"large{n}")
        least = large.groupBy("big").agg(F.min("small").alias("least"))
        small = large.join(least, "big").select(F.when(F.col("small") > F.col("least"), F.col("small")).otherwise(F.col("big")).alias("big"), F.col("least").alias("small")).distinct()
        nxt = tmp.keep(small, f"round{n + 1}")
        now = _mark(nxt)
        tmp.drop(f"round{n}")
        tmp.drop(f"large{n}")
        cur, n = nxt, n + 1
        if now == mark:
            break
        mark = now
    roots = cur.select(F.col("small").alias("node")).distinct().withColumn("root", F.col("node"))
    return cur.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)
