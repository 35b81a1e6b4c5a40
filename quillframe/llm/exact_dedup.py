"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text (all white space deleted).
A batch is digested once, its copies are folded together with map-side combining, what the index already holds is
removed by a sort-merge anti-join on the digest, and the rest is appended to the index.

Batches: without a label each call is a batch of its own. A label names one batch for good: calling again with it and the
same rows, say after a failure, changes nothing and gives the same decisions; other rows under a used label are refused.

Defined results: a null text counts as empty, and empty texts are one group. A row with a null id can stay, but loses
to any row with an id of the same length. Repeated rows with the same id, length and text: one of them stays. An empty
table gives an empty result. Other columns are neither read nor returned, so their names can't clash; `keep_first`
returns them as they are.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, numbered, split_lookup, without

COLUMNS = "digest binary, keep_id bigint, batch string, n_chars int, group_rows bigint"
BATCHES = "batch string, n_rows bigint, checksum decimal(38,0), buckets int"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


class DigestIndex:
    """A digest index in a folder. Opening a folder that has one continues it, also from another session, with its buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        held = self.batches().select("buckets").first()
        self.buckets = held.buckets if held else buckets
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        spark.sql(
            f"create table if not exists {self.table} ({COLUMNS}) "
            f"using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/index'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def batches(self) -> DataFrame:
        """One row per batch: its label, number of rows and a check sum of them, and the buckets of the index."""
        try:
            return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], BATCHES)

    def close(self) -> None:
        """Takes the catalogue entry away; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def _enter(self, batch: str, rows: DataFrame) -> int:
        """Writes the batch down before anything is appended, and returns its number of rows."""
        checksum = F.coalesce(F.sum(F.xxhash64("doc_id", "digest", "n_chars").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum")
        mine = rows.agg(F.lit(batch).alias("batch"), F.count("*").alias("n_rows"), checksum, F.lit(self.buckets).alias("buckets"))
        asked = mine.first()
        known = self.batches().filter(F.col("batch") == batch).first()
        if known is None:
            self.spark.createDataFrame([asked], BATCHES).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        elif (known.n_rows, known.checksum) != (asked.n_rows, asked.checksum):
            raise ValueError(f"the index has a batch {batch!r} with other rows")
        return asked.n_rows

    def ingest(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
        """Adds a batch and returns one row for each of its rows: doc_id, keep_id, group_size, kept, text_sha256, row.

        Of equal texts in a batch the row with the most code points, then the smallest id, stays; a text that an earlier
        batch brought stays there. group_size counts the batch's rows and those of the batch that first brought the text.
        """
        tmp, batch = Scratch(self.spark, "exact-dedup"), batch or uuid.uuid4().hex
        number = F.col(row_col) if row_col else F.monotonically_increasing_id()
        rows = tmp.keep(
            docs.select(
                number.alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_chars"),
            ),
            "rows",
        )
        total = self._enter(batch, rows)
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
        groups = tmp.keep(rows.groupBy("digest").agg(best, F.count("*").alias("group_rows")), "groups")
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti").select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch"), (-F.col("best.less")).alias("n_chars"), "group_rows"
        )
        self._append(tmp.keep(new, "new"), "append")
        held = self.read().select("digest", "keep_id", "batch", F.col("group_rows").alias("held"))
        own = F.col("batch") == batch
        table = groups.select("digest", "group_rows", F.col("best.row").alias("best_row")).join(held.hint("merge"), "digest").select(
            "digest", "keep_id", F.when(own, F.col("best_row")).alias("keep_row"), "group_rows", F.when(own, F.col("group_rows")).otherwise(F.col("group_rows") + F.col("held")).alias("group_size")
        )
        table = tmp.keep(table, "table")
        tmp.drop("groups", "new")
        found = split_lookup(rows, table, "digest", total)
        return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")

    def _append(self, new: DataFrame, mode: str) -> None:
        dealt = new.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
        dealt.mode(mode).format("parquet").option("path", f"{self.path}/index").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self) -> None:
        """Rewrites each bucket as one sorted file; appends leave one file per bucket and batch."""
        tmp = Scratch(self.spark, "exact-dedup")
        self._append(tmp.keep(self.read(), "whole"), "overwrite")
        tmp.drop()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Decisions over one table, by way of a fresh index that goes when they are made."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "digest-index")
    index = DigestIndex(spark, f"{tmp.root}/index", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8))
    try:
        return index.ingest(docs, None, id_col, text_col, row_col)
    finally:
        index.close()
        tmp.drop()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    tmp = Scratch(docs.sparkSession, "exact-dedup-kept")
    rows, row = numbered(docs, tmp)
    decisions = dedup(rows, id_col, text_col, row)
    return without(rows, tmp.keep(decisions.filter("not kept").select(F.col("row").alias(row)), "dropped"), row)
