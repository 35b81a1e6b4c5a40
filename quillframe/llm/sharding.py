"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

The hash of a record's id names one of some thousand virtual slots for good, whatever becomes of its text. Rows of a repeated or null id
have nothing of their own but their place, so the hash of their row number names theirs, and a third of all rows with one id
spread over all slots; which ids repeat is counted first. Bytes and rows are summed per slot (map-side first),
and only this bounded table reaches the driver, which gives each slot to a shard: longest slots first, each to the
lightest shard. The map is stored as version 0, 1, ...; rebalancing edits the latest one, moving as few slots as
bring the shards to their target, and stores the next. Records never look at anything but hash and map.

Defined results: a null text has no bytes (its size is 1). Row numbers are file and place for rows that come straight from whole Parquet
files, so their slots are the same in each call; rows of repeated ids from other sources spread anew in each call.
An empty table gives an empty result. Extra columns are not read, but `write_shards` writes them; one named shard raises.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, fresh, numbered


def with_slots(docs: DataFrame, tmp: Scratch, slots: int, id_col: str = "doc_id") -> tuple[DataFrame, str, str]:
    """docs with columns for the row number and the virtual slot, and their names.

    Up to BROADCAST_ROWS repeated ids are broadcast. Beyond that, those with over a thousandth of the repeated rows are (fewer than
    a thousand), and the others meet the rows by a merge join in which none has more than that share.
    """
    rows, row = numbered(docs, tmp)
    slot, key, again = (fresh(rows, n) for n in ("virtual_slot", "slot_key", "repeated"))
    ids = docs.select(F.col(id_col).cast("long").alias(key)).filter(F.col(key).isNotNull())
    repeated = tmp.keep(ids.groupBy(key).agg(F.count("*").alias(again)).filter(F.col(again) > 1), "repeated")
    seen = repeated.agg(F.count("*").alias("ids"), F.coalesce(F.sum(again), F.lit(0)).alias("rows")).first()
    keyed = rows.withColumn(key, F.col(id_col).cast("long"))
    if seen.ids <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(repeated), key, "left")
    else:
        hot = F.col(again) > seen.rows // 1000
        first = keyed.join(F.broadcast(repeated.filter(hot)), key, "left")
        rest = first.filter(F.col(again).isNull()).drop(again).join(repeated.filter(~hot).hint("merge"), key, "left")
        met = first.filter(F.col(again).isNotNull()).unionByName(rest)
    alone = F.col(key).isNotNull() & F.col(again).isNull()
    number = F.pmod(F.xxhash64(F.when(alone, F.col(key)).otherwise(F.col(row)), alone.cast("int")), F.lit(slots)).cast("int")
    return met.withColumn(slot, number).drop(key, again), row, slot


def slot_rows(docs: DataFrame, tmp: Scratch, slots: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, virtual_slot)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base, row, slot = with_slots(docs, tmp, slots, id_col)
    return base.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.col(slot).alias("virtual_slot"))


def assign(weights: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """Longest slots first, each to the lightest shard; empty slots are dealt round."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda x: (-weights.get(x, 0), x)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard)) if weights.get(slot) else heapq.heappush(heap, (load, shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map: slots leave shards that are over the mean (or gone), largest that fit first, for the lightest shards."""
    load = dict.fromkeys(range(shards), 0)
    homeless, members = [], {s: [] for s in range(shards)}
    for slot, shard in old.items():
        if shard < shards:
            load[shard] += weights.get(slot, 0)
            members[shard].append(slot)
        else:
            homeless.append(slot)
    mean = sum(weights.get(s, 0) for s in old) / shards
    new = dict(old)
    for shard in sorted(load, key=lambda s: -load[s]):
        for slot in sorted(members[shard], key=lambda x: (-weights.get(x, 0), x)):
            if weights.get(slot, 0) and load[shard] - weights[slot] >= mean:
                load[shard] -= weights[slot]
                homeless.append(slot)
    heap = [(v, k) for k, v in load.items()]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda x: (-weights.get(x, 0), x)):
        light, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (light + weights.get(slot, 0), shard))
    return new


class SlotMap:
    """Versions of a slot-to-shard map under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def store(self, shard_of: dict[int, int], weights: dict[int, int]) -> int:
        version = max(self.versions(), default=-1) + 1
        rows = [(slot, shard, weights.get(slot, 0)) for slot, shard in sorted(shard_of.items())]
        self.spark.createDataFrame(rows, "virtual_slot int, shard int, bytes bigint").coalesce(1).write.parquet(f"{self.path}/version={version}")
        return version

    def frame(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={max(self.versions()) if version is None else version}")

    def load(self, version: int | None = None) -> tuple[dict[int, int], dict[int, int]]:
        rows = self.frame(version).collect()  # one row per virtual slot
        return {r.virtual_slot: r.shard for r in rows}, {r.virtual_slot: r.bytes for r in rows}


def slot_weights(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}  # one row per virtual slot


def place(rows: DataFrame, slot_map: DataFrame, salts: int = 16) -> DataFrame:
    """Adds shard and slot, the row's place in its shard (gapless from 0): counts before its virtual slot and salt plus its place there.

    A virtual slot is numbered by `salts` tasks, so that one with very many rows is no single task's.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("virtual_slot", "salt").count().join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    order = Window.partitionBy("shard").orderBy("virtual_slot", "salt")
    before = counts.select("virtual_slot", "salt", "shard", (F.sum("count").over(order) - F.col("count")).alias("before"))  # slots * salts rows at most
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "salt").orderBy("doc_id", "text_crc32", "row")).cast("long") - 1
    return salted.withColumn("inside", inside).join(F.broadcast(before), ["virtual_slot", "salt"]).select(*rows.columns, "shard", (F.col("before") + F.col("inside")).alias("slot"))


def shard(docs: DataFrame, shards: int = 16, slots: int = 4096, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with their shard. With a store that has a map, its latest version is edited for the new bytes and shard count."""
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    rows = tmp.keep(slot_rows(docs, tmp, slots, id_col, text_col), "rows")
    tmp.drop("repeated", "files", "ordinals", "numbered")
    weights = slot_weights(rows)
    maps = SlotMap(spark, store or f"{tmp.root}/map")
    if maps.versions():
        maps.store(rebalance(maps.load()[0], weights, shards), weights)
    else:
        maps.store(assign(weights, shards, slots), weights)
    return place(rows, maps.frame())


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = 4096, file_bytes: int = 256 << 20, id_col: str = "doc_id") -> None:
    """Writes all rows of docs, with all their columns, into shard=N folders by a version of the map that was made for them.

    A row finds its shard by its own slot. Texts are shuffled once, into files of some file_bytes of text (by the bytes in the
    map); rows are dealt to a shard's files by their numbers, so that equal rows spread too.
    """
    most = slot_map.groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.coalesce(F.max("bytes"), F.lit(0)), F.count("*")).first()
    parts = max(-(-most[0] // file_bytes), 1)
    if fresh(docs, "shard") != "shard":
        raise ValueError("docs have a column named shard, which is the name of the folders")
    tmp = Scratch(docs.sparkSession, "shards")
    named, row, slot = with_slots(docs, tmp, slots, id_col)
    part = fresh(named, "part")
    named = named.join(F.broadcast(slot_map.select(F.col("virtual_slot").alias(slot), "shard")), slot).withColumn(part, F.pmod(F.xxhash64(row), F.lit(parts)))
    named.repartition(max(most[1] * parts, 1), "shard", part).drop(slot, part, row).write.partitionBy("shard").parquet(path)
    tmp.drop()
