"""Document fingerprints by SimHash, all in DataFrame functions.

Terms are the pairs of neighbouring words of the lower-cased text (a single word by itself). A term's XXH64 votes with
its weight on 64 signed bits: a bit is 1 where the terms that have it outweigh the others. A term weighs as much as
it has characters, up to 24: pairs of short function words are in all texts of a language and say little. The votes of a
text are summed JVM-side, two bits to a long.

`within_radius` finds all fingerprints within a Hamming radius of query fingerprints by permuted block tables: the bits
are cut into `blocks` blocks; a pair within the radius agrees on at least blocks - radius of them. For each choice of so
many blocks there is one table whose key is those blocks' bits; queries and fingerprints meet by equality of table and
key and are verified. Equal fingerprints are folded into one class before.

`with_next` pairs every text with the next one in descending order of id without a global sort: the order (id, then a hash of
the text) is cut at quantiles of a sample into ranges of some RANGE_BYTES of text, each range's rows meet in one task, and the
first row of a range is also sent, as a guest, to the range before it. Null and repeated ids are cut by the hash like others.

Defined results: a null text counts as empty; a text without words has fingerprint 0. Null ids come last. The only row of a table is its own next. An empty table gives an empty result. Extra columns are
not read. The order of rows with one id, and of those without an id, is that of a hash of their texts.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fingerprint_of, hex16, split_lookup, votes, words_of

LONGEST = 24
#: Text of one range, ranges at most (their cuts are one row that is broadcast), and sampled rows for each cut.
RANGE_BYTES, RANGES, SAMPLES = 64 << 20, 50_000, 20


def fingerprinted(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and fp, one row per row; keys must name a row."""
    base = rows.select(*keys, words_of(F.lower(F.col(text_col))).alias("words"))
    places = base.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0)))).alias("at"))
    term = F.concat_ws(" ", F.get("words", F.col("at")), F.get("words", F.col("at") + 1))
    hashed = places.select(*keys, F.when(F.size("words") > 0, term).alias("term")).select(*keys, F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h"), F.least(F.char_length("term"), F.lit(LONGEST)).cast("long").alias("w"))
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *votes(F.col("h"), F.col("w")))
    return summed.select(*keys, fingerprint_of(F.coalesce("total", F.lit(0))).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def _place() -> Column:
    """Where a row stands in the descending order: its id (null is lowest), then a hash of its text."""
    return F.struct("doc_id", "h")


def _cuts(light: DataFrame, parts: int | None) -> DataFrame:
    """One row: chunks of places that cut the order into ranges of about equal numbers of rows, and how many cuts follow each chunk."""
    spark = light.sparkSession
    total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = parts or min(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total[1] // RANGE_BYTES)), RANGES)
    every = max(total[0] // (SAMPLES * parts), 1)
    sample = light.filter(F.pmod(F.xxhash64("doc_id", "h", F.monotonically_increasing_id()), F.lit(every)) == 0)
    number = F.row_number().over(Window.orderBy("doc_id", "h"))  # some SAMPLES * parts rows
    rows = sample.withColumn("n", number).filter(F.col("n") % SAMPLES == 0).select("doc_id", "h").distinct().collect()  # parts rows or so
    cuts = sorted(((r.doc_id, r.h) for r in rows), key=lambda x: (x[0] is not None, x))
    step = max(math.isqrt(len(cuts)), 1)
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    beyond = [len(cuts) - min(i + step, len(cuts)) for i in range(0, len(cuts), step)]
    return spark.createDataFrame([([c[0] for c in chunks], chunks, beyond, len(cuts))], "firsts array<struct<doc_id:bigint,h:bigint>>, chunks array<array<struct<doc_id:bigint,h:bigint>>>, beyond array<int>, cuts int")


def _number() -> Column:
    """The range of a row beside the one row of cuts: how many cuts are above its place. The chunk to search is found first."""
    place = _place()
    above = F.size(F.filter("firsts", lambda b: b > place))  # chunks that begin above it lie wholly above it
    mine = F.size("firsts") - 1 - above
    inside = F.size(F.filter(F.get("chunks", mine), lambda b: b > place))
    return F.when(mine < 0, F.col("cuts")).otherwise(F.get("beyond", mine) + inside).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """range, place, guest, doc_id, text, next_text: place numbers a range's rows; guests, last, are copies of the next range's first row."""
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "next")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    light = tmp.keep(base.select("doc_id", "h", F.octet_length("text").cast("long").alias("size")), "light")
    cuts = F.broadcast(tmp.keep(_cuts(light, parts), "cuts"))  # one row
    found = light.join(cuts).select(_number().alias("range"), _place().alias("at")).groupBy("range").agg(F.max("at").alias("top"))
    tops = found.orderBy("range").collect()  # one row per range
    rows = [(r["range"], r["top"], tops[i - 1]["range"]) for i, r in enumerate(tops)]
    tops = spark.createDataFrame(rows, "range int, top struct<doc_id:bigint,h:bigint>, before int")
    placed = base.join(cuts).select("doc_id", "h", "text", _number().alias("range")).join(F.broadcast(tops), "range")
    home = F.struct(F.col("range"), F.lit(False).alias("guest"))
    both = F.array(home, F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))
    dealt = placed.withColumn("to", F.explode(F.when(_place() == F.col("top"), both).otherwise(F.array(home)))).select("to.range", "to.guest", "doc_id", "h", "text")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text")
    return dealt.select("range", F.row_number().over(order).alias("place"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, its edited text's, and the likeness to that and to the next text's. Texts are shuffled once."""
    met = with_next(docs, id_col, text_col)
    keys = ["range", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    new = F.when(~F.col("guest"), edited(F.col("text"), F.col("next_text")))
    base = met.select("range", "place", "guest", "doc_id", F.char_length("text").alias("n_chars"), "text", new.alias("new")).withColumn("edited_sha256", F.sha2(F.col("new"), 256))
    both = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("new").alias("t"))))
    texts = base.select(*keys, F.explode(both).alias("x")).select(*keys, "x.which", "x.t")
    prints = fingerprinted(texts, [*keys, "which"], "t")
    one = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("place"))
    done = one.withColumn("next_fp", following).filter("not guest")
    return done.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """[(table, key)]: for each choice of blocks - radius blocks, the fingerprint with the other blocks masked."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """queries, stored: column fp, distinct. (query_fp, fp, bits): every stored fingerprint within the radius of a query, itself included."""
    left = queries.select(F.col("fp").alias("query_fp"), F.inline(block_keys(F.col("fp"), blocks, radius)))
    right = stored.select("fp", F.inline(block_keys(F.col("fp"), blocks, radius)))
    bits = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    return left.join(right, ["table", "key"]).select("query_fp", "fp", bits.alias("bits")).filter(F.col("bits") <= radius).distinct()


def fingerprint_report(docs: DataFrame, radius: int = 3, blocks: int = 6, every: int = 100) -> DataFrame:
    """fingerprint_edits plus, for ids divisible by `every`, how many classes and documents lie within the radius (own included)."""
    tmp = Scratch(docs.sparkSession, "fingerprint")
    rows = tmp.keep(fingerprint_edits(docs), "rows")
    classes = tmp.keep(rows.groupBy("fp").agg(F.count("*").alias("docs"), F.max(F.pmod("doc_id", F.lit(every)) == 0).alias("asked")), "classes")
    found = within_radius(classes.filter("asked").select("fp"), classes.select("fp"), radius, blocks)
    near = found.join(classes.select("fp", "docs"), "fp").groupBy(F.col("query_fp").alias("fp")).agg(F.count("*").alias("near_classes"), F.sum("docs").alias("near_documents"), F.max(F.when(F.col("fp") == F.col("query_fp"), F.col("docs"))).alias("group_rows"))
    asked = F.pmod("doc_id", F.lit(every)) == 0
    told = split_lookup(rows.filter(asked), tmp.keep(near, "near"), "fp", rows.count()).drop("group_rows").unionByName(rows.filter(F.coalesce(~asked, F.lit(True))), allowMissingColumns=True)
    return told.select("doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "near_classes", "near_documents")
