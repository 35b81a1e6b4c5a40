"""Shared pieces of the corpus operators: scratch tables, skew-safe look-ups, word splitting and SimHash voting.

Nothing here looks at the data on the driver except counts and explicitly bounded tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.scratch import Scratch, scratch_root, settings  # noqa: F401
from quillframe.shipping import ship as ship_sources

# White space of every corpus operator: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: No more than this many keys are treated as hot, because each of them holds over 1/HOT_KEYS of all rows.
HOT_KEYS = 1000

#: Files whose paths one task may number and a broadcast may hold (some 10 MB).
FILES = 100_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, tmp: Scratch) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, the same in each scan, and the name of that column.

    Whole Parquet files are numbered by file and place in the file, which no new plan, core count or lost executor changes,
    and are not copied. Anything else (other sources, filtered rows, joins) is written once with its numbers.
    """
    name = fresh(docs, "row_number")
    try:
        place = docs.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").cast("long").alias("i"))
    except AnalysisException:
        place = None
    if place is not None:
        wide = F.col("i").cast("decimal(38,0)")
        files = tmp.keep(place.groupBy("f").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.sum(wide).alias("s"), F.sum(wide * F.col("i")).alias("q")), "files")
        n = F.col("n").cast("decimal(38,0)")
        whole = (F.col("n") == F.col("last") + 1) & (F.col("s") * 2 == n * (n - 1)) & (F.col("q") * 6 == n * (n - 1) * (2 * n - 1))  # each place once
        seen = files.agg(F.count("*").alias("files"), F.coalesce(F.bool_and(F.coalesce(whole, F.lit(False))), F.lit(True)).alias("whole")).first()
        if seen.whole and seen.files <= FILES:
            path, index = fresh(docs, "file_path"), fresh(docs, "file_place")
            first = files.select(F.col("f").alias(path), ((F.row_number().over(Window.orderBy("f")).cast("long") - 1) * (1 << 40)).alias(name))  # FILES rows at most
            placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
            met = placed.join(F.broadcast(tmp.keep(first, "ordinals")), path)
            return met.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns], (F.col(name) + F.col(index)).alias(name)), name
    return tmp.keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def split_lookup(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "group_rows") -> DataFrame:
    """Inner join of rows with a table that has each key once and, in column `count`, how many rows have the key.

    Keys with more than 1/HOT_KEYS of the rows (so fewer than HOT_KEYS of them) meet the rows by a broadcast and never
    pass a shuffle; the others meet in a sort-merge join in which no key has more than that share.
    """
    limit = max(total // HOT_KEYS, 1000)
    heavy = table.filter(F.col(count) > limit)
    names = F.broadcast(heavy.select(key).withColumn("_heavy", F.lit(True)))
    marked = rows.join(names, key, "left")
    hot = marked.filter("_heavy").drop("_heavy").join(F.broadcast(heavy), key)
    cold = marked.filter("_heavy is null").drop("_heavy").join(table.filter(F.col(count) <= limit).hint("merge"), key)
    return hot.unionByName(cold)


#: Row numbers are broadcast up to this many (16 MB); beyond it the rows meet them by a merge join.
BROADCAST_ROWS = 1_000_000


def light(table: DataFrame) -> DataFrame:
    """A kept table of a few numbers a row, hinted for a join: broadcast if it is small, else merged."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """docs, numbered in column `row`, without the rows whose numbers are in `dropped` (a kept table with that column)."""
    return docs.join(light(dropped), row, "left_anti").drop(row)


def ascii_lower(s: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast path; what has no upper case is returned as it is."""
    low = F.lower(s)
    return F.when(low == s, s).when(F.octet_length(s) == F.char_length(s), low).otherwise(F.translate(s, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text, split at white space; an empty array where there is none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+", -1))


def shingle_at(words: Column, at: Column, k: int) -> Column:
    """k words from `at` on, space-joined; all words if there are fewer; null if there is none."""
    parts = [F.get(words, at + i) for i in range(k)]
    return F.when(F.size(words) >= k, F.concat_ws(" ", *parts)).when(F.size(words) > 0, F.concat_ws(" ", *parts))


LANE = 0x0000000100000001


def votes(h: Column, weight: Column | None = None) -> list[Column]:
    """32 sums, each with the votes for bit i in its low and for bit i + 32 in its high half: one long adds two bits.

    A half holds totals up to 2**31 - 1, that is, texts of two thousand million terms, or as many divided by the largest weight.
    """
    def one(i: int) -> Column:
        bits = F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANE))
        return F.sum(bits if weight is None else bits * weight).alias(f"v{i}")

    return [one(i) for i in range(32)]


def fingerprint_of(total: Column) -> Column:
    """The 64-bit fingerprint: a bit is 1 if its votes are over half the total."""
    fp = F.lit(0).cast("long")
    for i in range(32):
        v = F.coalesce(F.col(f"v{i}"), F.lit(0).cast("long"))
        low = (v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total).cast("long")
        high = (F.shiftrightunsigned(v, 32) * 2 > total).cast("long")
        fp = fp.bitwiseOR(F.shiftleft(low, i)).bitwiseOR(F.shiftleft(high, i + 32))
    return fp


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Bytes of rows in one Arrow batch. Spark's own 64 MB are held several times over, in the JVM and in the worker.
ARROW_BATCH = "4194304b"


def ship(spark: SparkSession) -> None:
    """Readies a session for Python workers: this package's sources and smaller Arrow batches (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "-1b"):
        spark.conf.set(key, ARROW_BATCH)
    ship_sources(spark)


def give_back() -> None:
    """At the end of a task in a Python worker, which lives on: returns freed memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc
