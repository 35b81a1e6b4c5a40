"""Near-duplicate frames by indexes: no frame meets all others of its job.

Hashes that differ in at most `radius` bits agree wholly in some choice of blocks (`block_masks`), so they share a key in one of a few tables;
equal hashes are one node. Numbers within a distance fall into neighbouring buckets. What an index fetches is compared
exactly, so results are those of comparing all pairs.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.scratch import Scratch
from quillframe.shipping import ship

#: Tables of an index at most, and the fewest bits a key should have; a radius that has no such index is searched chunk against chunk.
TABLES, KEY_BITS, CHUNKS = 64, 12, 16
#: Best undecided hashes of a job in a round, where no index helps (up to 1000 Spark picks them before it shuffles), and the most chosen ones that are broadcast.
HEAD, BROADCAST_HASHES = 1000, 500_000


def radius_of(least: float, bits: int) -> int:
    """The most differing bits of hashes whose likeness (1 - bits that differ / bits, to four places) is `least` or more."""
    return max((d for d in range(bits + 1) if round(1 - d / bits, 4) >= least), default=-1)


def block_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of the blocks that stay when `radius` of them are left out, for the finest cut with at most TABLES choices; none if keys would be short."""
    best: list[int] = []
    for blocks in range(radius + 1, bits + 1):
        if math.comb(blocks, radius) > TABLES:
            break
        cuts = [bits * i // blocks for i in range(blocks + 1)]
        best = [sum(((1 << cuts[i + 1] - cuts[i]) - 1) << cuts[i] for i in kept) for kept in itertools.combinations(range(blocks), blocks - radius)]
    return best if best and min(m.bit_count() for m in best) >= KEY_BITS else []


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(nodes: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """(job, a, b): hashes a < b of a job that differ in 1 to radius bits. nodes: distinct (job, hash).

    A pair that several tables find counts in the first in which it agrees.
    """
    if radius <= 0:
        return nodes.limit(0).select("job", F.col("hash").alias("a"), F.col("hash").alias("b"))
    masks = block_masks(radius, bits)
    if masks:
        keys = [F.struct(F.lit(t).alias("t"), F.col("hash").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
        filed = nodes.select("job", "hash", F.explode(F.array(*keys)).alias("k")).select("job", "hash", "k.*")
    else:
        mine = F.pmod(F.xxhash64("hash"), F.lit(CHUNKS)).cast("int")
        filed = nodes.select("job", "hash", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("other")).select(
            "job", "hash", F.least("mine", "other").alias("t"), F.greatest("mine", "other").cast("long").alias("key"), "mine")
    a, b = filed.withColumnRenamed("hash", "a"), filed.withColumnRenamed("hash", "b")
    if masks:
        met = a.join(b, ["job", "t", "key"])
        differ = F.col("a").bitwiseXOR(F.col("b"))
        first = functools.reduce(lambda rest, tm: F.when(differ.bitwiseAND(F.lit(_signed(tm[1]))) == 0, tm[0]).otherwise(rest), reversed(list(enumerate(masks))), F.lit(-1))
        once = first == F.col("t")
    else:
        met = a.join(b.withColumnRenamed("mine", "its"), ["job", "t", "key"])
        once = (F.least("mine", "its") == F.col("t")) & (F.greatest("mine", "its") == F.col("key"))  # the two chunks of this cell
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return met.filter((F.col("a") < F.col("b")) & near & once).select("job", "a", "b")


def distinct_frames(df: DataFrame, job: str, score: str, order: str, hash_: str, least: float, bits: int = 64) -> DataFrame:
    """Best score first, a frame stays unless a frame that stays is `least` or more like it: the rows that stay. Ties go by order; job and order name a row.

    The same as going through a job's frames one by one: a frame is decided when all better ones near it are. In each round those
    without an undecided better neighbour stay and their neighbours go; rounds are as many as the longest chain of ever
    worse neighbours asks for. Of equal hashes only the best can stay, so rounds run over distinct hashes. Frames without a hash are like no other.
    """
    tmp, radius = Scratch(df.sparkSession, "distinct-frames"), radius_of(least, bits)
    if radius < 0:
        return df
    frames = df.select(F.col(job).alias("job"), F.col(order).alias("order"), F.col(hash_).alias("hash"), F.struct((-F.col(score)).alias("less"), F.col(order).alias("order")).alias("rank"))
    nodes = tmp.keep(frames.filter("hash is not null").groupBy("job", "hash").agg(F.min("rank").alias("rank")), "nodes")
    if radius > 0 and not block_masks(radius, bits):
        return df.join(_kept_by_heads(nodes, radius, tmp).select("job", F.col("rank.order").alias("order")).unionByName(frames.filter("hash is null").select("job", "order")).select(F.col("job").alias(job), F.col("order").alias(order)), [job, order], "left_semi")
    pairs = near_pairs(nodes.select("job", "hash"), radius, bits)
    ranked = pairs.join(nodes.select("job", F.col("hash").alias("a"), F.col("rank").alias("ra")), ["job", "a"]).join(nodes.select("job", F.col("hash").alias("b"), F.col("rank").alias("rb")), ["job", "b"])
    first = F.col("ra") < F.col("rb")
    edges = tmp.keep(ranked.select("job", F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), "edges0")
    gone, n = [], 0
    while not edges.isEmpty():
        sure = edges.join(edges.select("job", F.col("worse").alias("better")).distinct(), ["job", "better"], "left_anti").select("job", "better").distinct()
        out = tmp.keep(edges.join(sure, ["job", "better"], "left_semi").select("job", F.col("worse").alias("hash")).distinct(), f"gone{n}")
        left = edges.join(out.select("job", F.col("hash").alias("worse")), ["job", "worse"], "left_anti").join(out.select("job", F.col("hash").alias("better")), ["job", "better"], "left_anti")
        gone.append(out)
        edges, n = tmp.keep(left, f"edges{n + 1}"), n + 1
        tmp.drop(f"edges{n - 1}")
    stay = nodes.join(functools.reduce(DataFrame.unionByName, gone), ["job", "hash"], "left_anti") if gone else nodes
    kept = stay.select("job", F.col("rank.order").alias("order")).unionByName(frames.filter("hash is null").select("job", "order"))
    return df.join(kept.select(F.col("job").alias(job), F.col("order").alias(order)), [job, order], "left_semi")


def _kept_by_heads(nodes: DataFrame, radius: int, tmp: Scratch) -> DataFrame:
    """The nodes (job, hash, rank) that stay, for a radius that no index serves: hashes far from each other are then few, and each rules out many.

    In each round the HEAD best undecided hashes of a job are decided among themselves, and those near one that stays go, so that every hash is compared
    with hashes that stay only, not with its whole job.
    """
    ship(nodes.sparkSession)

    def decide(head: pd.DataFrame) -> pd.DataFrame:
        head = head.sort_values("place", ignore_index=True)
        left, kept = head["hash"].to_numpy().astype("int64"), []
        at = np.arange(len(left))
        while len(at):
            kept.append(at[0])
            far = np.bitwise_count((left[at] ^ left[at[0]]).view("uint64")) > radius
            at = at[far]
        return head.iloc[kept][["job", "hash"]]

    schema = f"job {nodes.schema['job'].dataType.simpleString()}, hash bigint"
    undecided, chosen, n = nodes, [], 0
    while not undecided.isEmpty():
        place = F.row_number().over(Window.partitionBy("job").orderBy("rank"))
        head = undecided.select("job", "hash", "rank").withColumn("place", place).filter(F.col("place") <= HEAD).select("job", "hash", "place")
        stay = tmp.keep(head.groupBy("job").applyInPandas(decide, schema), f"stay{n}")
        k = stay.select(F.col("job").alias("_job"), F.col("hash").alias("_hash"))
        near = F.col("job").eqNullSafe(F.col("_job")) & (F.bit_count(F.col("hash").bitwiseXOR(F.col("_hash"))) <= radius)
        undecided = tmp.keep(undecided.join(F.broadcast(k) if stay.count() <= BROADCAST_HASHES else k, near, "left_anti"), f"undecided{n}")
        chosen.append(stay)
        if n:
            tmp.drop(f"undecided{n - 1}")
        n += 1
    return nodes.join(functools.reduce(DataFrame.unionByName, chosen), ["job", "hash"], "left_semi") if chosen else nodes


def redundant_hashes(df: DataFrame, job: str, order: str, hash_: str, above: float, bits: int = 64) -> DataFrame:
    """Adds redundant: an earlier frame of the job, redundant or not, is more than `above` like it. Only the first frame of each hash meets others."""
    radius = max((d for d in range(bits + 1) if round(1 - d / bits, 4) > above), default=-1)
    name = [job, hash_]
    nodes = df.filter(F.col(hash_).isNotNull()).groupBy(*name).agg(F.min(order).alias("first")).select(F.col(job).alias("job"), F.col(hash_).alias("hash"), "first")
    pairs = near_pairs(nodes.select("job", "hash"), radius, bits)
    both = pairs.select("job", F.explode(F.array(F.struct(F.col("a").alias("hash"), F.col("b").alias("other")), F.struct(F.col("b").alias("hash"), F.col("a").alias("other")))).alias("x")).select("job", "x.*")
    earliest = both.join(nodes.select("job", F.col("hash").alias("other"), F.col("first").alias("its")), ["job", "other"]).groupBy("job", "hash").agg(F.min("its").alias("near"))
    known = nodes.join(earliest, ["job", "hash"], "left").select(F.col("job").alias(job), F.col("hash").alias(hash_), (F.least("first", "near") if radius >= 0 else F.lit(None)).alias("_seen"))
    return df.join(known, name, "left").withColumn("redundant", F.coalesce(F.col("_seen") < F.col(order), F.lit(False))).drop("_seen").select(*df.columns, "redundant")


def redundant_values(df: DataFrame, job: str, order: str, value: str, above: float) -> DataFrame:
    """The same for numbers, whose likeness is 1 - |a - b|: each looks into its bucket and two on either side, in which running extremes of the earlier ones are enough."""
    width = (1 - above) * 0.9
    slot = F.floor(F.col(value).cast("double") / width)
    tagged = df.withColumn("_slot", slot).withColumn("_to", F.explode(F.sequence(slot - 2, slot + 2)))
    before = Window.partitionBy(job, "_to").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    v, home = F.col(value), F.col("_slot") == F.col("_to")
    below, above_ = F.max(F.when(F.col("_slot") < F.col("_to"), v)).over(before), F.min(F.when(F.col("_slot") > F.col("_to"), v)).over(before)
    same = F.coalesce(F.max(home.cast("int")).over(before), F.lit(0)) > 0

    def like(other: Column) -> Column:
        return F.coalesce(1 - F.abs(other - v).cast("double") > above, F.lit(False))

    told = tagged.withColumn("redundant", same | like(below) | like(above_)).filter(home)
    missing = df.filter(F.col(value).isNull()).withColumn("redundant", F.lit(False))
    return told.drop("_slot", "_to").unionByName(missing)
