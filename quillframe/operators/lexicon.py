"""Phrases of a lexicon in texts, by an index on each phrase's rarest pair of words.

The index is a table: a phrase is filed under its word or, if it has several, under the two neighbours, with what is between them, that the fewest phrases have. Texts are cut into pieces with an
overlap of the longest phrase, the words and neighbours of the pieces meet the index by equality, and only what they fetch is compared
with the text. The cost per word does not depend on the size of the lexicon; no expression lists phrases. Hits are then chosen longest phrase first
over the whole text (ties: the phrase declared first, then the earlier place), and what overlaps a chosen one goes.

A phrase starts and ends at word borders, case does not matter; words are runs of letters, digits and underscores. As in a search for
one phrase from left to right, an occurrence that overlaps an earlier one of the same phrase is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions.spans import bound, resolve, spans

WORD = r"[\p{L}\p{N}_]+"
ATOMS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Code points of a piece.
PIECE = 400
#: A lexicon of more phrases than this is not broadcast.
BROADCAST_PHRASES = 100_000

HIT = "struct<start:int,end:int,less:int,place:bigint,text:string,phrase:string,canonical:string,label:string>"


def lexicon_table(spark: SparkSession, lexicon: list[tuple[str, str, str]]) -> DataFrame:
    """(phrase, canonical, label, place) of a list in order of declaration."""
    return spark.createDataFrame([(p, c, label, i) for i, (p, c, label) in enumerate(lexicon)], "phrase string, canonical string, label string, place bigint")


def _repeats(p: Column) -> Column:
    """Whether a phrase may overlap itself: it ends in a part, after a sign that is no word's, with which it begins."""
    return F.exists(F.sequence(F.lit(1), F.char_length(p) - 1), lambda k: (F.substring(p, F.lit(1), k) == F.right(p, k)) & ~F.substring(p, F.char_length(p) - k, F.lit(1)).rlike(WORD))


def phrase_index(lexicon: DataFrame) -> DataFrame:
    """(word, at, phrase, size, place, canonical, label, again) from (phrase, canonical, label, place); of entries in one spelling the last counts, at the place of the first.

    Phrases of one sign are left out, as are those without a word: they have no border on both sides.
    """
    last = lexicon.groupBy(F.lower("phrase").alias("phrase")).agg(F.max_by("canonical", "place").alias("canonical"), F.max_by("label", "place").alias("label"), F.min("place").alias("place"))
    found = last.filter(F.char_length("phrase") >= 2).withColumn("w", spans(F.col("phrase"), WORD))
    # one word, or each word with what follows it up to the end of the next
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a["start"].alias("at"), F.substring(F.col("phrase"), a["start"] + 1, b["end"] - a["start"]).alias("word")))
    alone = F.transform("w", lambda a: F.struct(a["start"].alias("at"), a["text"].alias("word")))
    words = found.filter(F.size("w") > 0).select("phrase", "canonical", "label", "place", F.explode(F.when(F.size("w") > 1, pairs).otherwise(alone)).alias("k")).select("phrase", "canonical", "label", "place", "k.at", "k.word")
    common = words.groupBy("word").agg(F.count_distinct("phrase").alias("phrases"))
    rarest = F.row_number().over(Window.partitionBy("phrase").orderBy("phrases", -F.char_length("word"), "at"))
    filed = words.join(common, "word").withColumn("n", rarest).filter("n = 1")
    return filed.select("word", "at", "phrase", F.char_length("phrase").alias("size"), "place", "canonical", "label", _repeats(F.col("phrase")).alias("again"))


def _pieces(text: Column, longest: int) -> Column:
    """array of (offset, lead, piece): PIECE code points with the one before them (lead is 1 then) and those that a phrase begun in them may need."""
    def one(cut: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            before, after = F.coalesce(F.right(F.get(cut, i - 1), F.lit(1)), F.lit("")), F.coalesce(F.left(F.get(cut, i + 1), F.lit(longest + 1)), F.lit(""))
            return F.struct((i * PIECE - F.char_length(before)).alias("offset"), F.char_length(before).alias("lead"), F.concat(before, p, after).alias("piece"))

        return F.transform(cut, piece)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), one)


def phrase_hits(df: DataFrame, key: str, text: str, index: DataFrame, phrases: int) -> DataFrame:
    """Every occurrence: row, key, start, end, less (minus the size), place, text, phrase, canonical, label. `phrases`: how many the index has."""
    seen = index.agg(F.max("size").alias("longest"), F.coalesce(F.bool_or("again"), F.lit(False)).alias("again")).first()
    longest = min(seen.longest or 0, PIECE - 1)
    if (seen.longest or 0) >= PIECE:
        raise ValueError(f"a phrase of {seen.longest} signs; pieces have {PIECE}")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    # outer explodes: for plain ones the optimizer puts a filter below, and all would be cut twice
    pieces = rows.select("row", "key", F.explode_outer(_pieces(F.col("text"), longest)).alias("p")).select("row", "key", "p.*").withColumn("atoms", F.regexp_extract_all("piece", F.lit(ATOMS), F.lit(0)))
    three = F.arrays_zip("atoms", F.slice("atoms", F.lit(2), F.size("atoms")).alias("gap"), F.slice("atoms", F.lit(3), F.size("atoms")).alias("next"))
    words = pieces.filter("piece is not null").select("row", "key", "offset", "lead", "piece", F.posexplode_outer(three).alias("i", "a")).filter(F.col("a.atoms").rlike("^" + WORD))
    forms = words.select("row", "key", "offset", "lead", "piece", "i", F.explode(F.array(F.lower("a.atoms"), F.lower(F.concat("a.atoms", "a.gap", "a.next")))).alias("word"))
    met = forms.join(F.broadcast(index) if phrases <= BROADCAST_PHRASES else index, "word")
    start = F.char_length(F.array_join(F.slice(F.regexp_extract_all("piece", F.lit(ATOMS), F.lit(0)), F.lit(1), F.col("i")), "")) - F.col("at")
    met = met.select("*", F.explode(F.array(start)).alias("s"))  # an item of an array, so that it is found once for all that asks for it
    found = F.substring("piece", F.col("s") + 1, F.col("size"))
    before, after = F.when(F.col("s") > 0, F.substring("piece", F.col("s"), F.lit(1))).otherwise(""), F.substring("piece", F.col("s") + F.col("size") + 1, F.lit(1))
    border = (before.rlike(WORD) != F.left("phrase", F.lit(1)).rlike(WORD)) & (after.rlike(WORD) != F.right("phrase", F.lit(1)).rlike(WORD))
    here = (F.col("s") >= F.col("lead")) & (F.col("s") < F.col("lead") + PIECE)
    hits = met.filter(here).filter((F.lower(found) == F.col("phrase")) & border)
    start = F.col("offset") + F.col("s")
    hits = hits.select("row", "key", start.alias("start"), (start + F.col("size")).alias("end"), (-F.col("size")).alias("less"), "place", found.alias("text"), "phrase", "canonical", "label", "again")
    if not seen.again:
        return hits.drop("again")
    kept = "array<struct<start:int,end:int,text:string>>"
    chain = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), F.array().cast(kept), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > x["start"]), acc).otherwise(F.concat(acc, F.array(x))))
    again = hits.filter("again").groupBy("row", "key", "less", "place", "phrase", "canonical", "label").agg(chain.alias("chain")).withColumn("x", F.explode("chain"))
    return hits.filter("not again").drop("again").unionByName(again.select("row", "key", "x.*", "less", "place", "phrase", "canonical", "label"))


def lexicon_matches(df: DataFrame, key: str, text: str, lexicon: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """One row per chosen occurrence of a row's text: key, start, end, text, phrase, canonical, label. lexicon: a list or a table (phrase, canonical, label, place)."""
    table = lexicon if isinstance(lexicon, DataFrame) else lexicon_table(df.sparkSession, lexicon)
    phrases = table.count() if isinstance(lexicon, DataFrame) else len(lexicon)
    hits = phrase_hits(df, key, text, phrase_index(table), phrases)
    one = hits.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "less", "place", "text", "phrase", "canonical", "label"))).alias("hits"))
    chosen = one.select("key", F.explode(resolve(F.col("hits"), HIT, ["less", "place"])).alias("h"))
    return chosen.select(F.col("key").alias(key), "h.start", "h.end", "h.text", "h.phrase", "h.canonical", "h.label")
