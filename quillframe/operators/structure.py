"""Key-value pairs, lists, headers, data rows and tables in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import rules
from quillframe.functions.spans import bound
from quillframe.functions.text import strip

# Patterns of pairs (in order of precedence), list items and header lines. (?md): a line ends at a line feed only.
PAIR_PATTERNS = [r"(?md)^(.{2,50}?)\s*:\s+(.+)$", r"(?md)^(.{2,50}?)\s*[.]{3,}\s*(.+)$", r"(?md)^(.{2,50}?)\s*\|\s+(.+)$"]
LINE_PAIR_PATTERNS = [r"^(.{2,40}?)\s*[:]\s+(.+)$", r"^(.{2,40}?)\s*[.]{3,}\s*(.+)$", r"^(.{2,40}?)\s*[|]\s+(.+)$", r"^(.{2,40}?)\s*=\s+(.+)$"]
BULLET = r"^\s*[•\-*●○‣⁃◦>]\s+(.+)$"
NUMBER = r"^\s*(?:\d{1,3})[.)]\s+(.+)$"
LETTER = r"^\s*(?:[a-zA-Z])[.)]\s+(.+)$"
MAY_BE_PAIR, MAY_BE_CELLS = r"[:|=]|[.]{3}", r"\t| {3}"  # without such a sign no pattern of pairs or cells can match
ANY_NUMBER = r"^\s*(?:\d{1,3}[.)]\s+|[a-zA-Z][.)]\s+|(?:i{1,3}|iv|v|vi{0,3}|ix|x)[.)]\s+)(.+)$"


def key_values(df: DataFrame, key: str, text: str, labels: list[str] = rules.FORM_LABELS) -> DataFrame:
    """One row per pair: key, position, name, value, is_known_field. The first pair of a name (in any case) counts."""
    def pairs(n: int, pattern: str) -> Column:
        names, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
        both = F.zip_with(names, values, lambda a, b: F.struct(F.regexp_replace(strip(a), r"\.+$", "").alias("name"), strip(b).alias("value")))
        return F.transform(both, lambda x, i: F.struct(F.lit(n).alias("pattern"), i.alias("i"), x["name"], x["value"]))

    parts = [pairs(n, pattern) for n, pattern in enumerate(PAIR_PATTERNS)]
    found = df.select(key, F.explode(F.concat(*parts)).alias("p")).select(key, "p.*")
    found = found.filter((F.char_length("name") >= 2) & (F.char_length("name") <= 50) & (F.char_length("value") >= 1) & ~F.col("name").rlike("^[0-9]") & F.col("name").rlike(r"\p{L}"))
    low = F.lower(strip(F.col("name")))
    first = found.withColumn("_r", F.row_number().over(Window.partitionBy(key, low).orderBy("pattern", "i"))).filter("_r = 1")
    known = bound(low, lambda v: F.exists(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(v, x)))
    return first.select(key, "pattern", "i", "name", "value", known.alias("is_known_field"))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_num, line): stripped lines."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_num", "line")).withColumn("line", strip(F.col("line")))


def _islands(typed: DataFrame, key: str) -> DataFrame:
    """Runs of neighbouring lines of one type: key, island, type, items, start_line, the type of the line after."""
    w = Window.partitionBy(key).orderBy("line_num")
    begins = (F.col("type") != F.lag("type").over(w)) | F.lag("type").over(w).isNull()
    marked = typed.withColumns({"island": F.sum(F.when(begins, 1).otherwise(0)).over(w), "after": F.lead("type").over(w)})
    listed = marked.filter("type != 'other'")
    parts = F.array_sort(F.collect_list(F.struct("line_num", "item", "after")))
    return listed.groupBy(key, "island", "type").agg(parts.alias("p")).select(key, "island", "type", F.transform("p", lambda x: x["item"]).alias("items"), F.col("p")[0]["line_num"].alias("start_line"), F.element_at("p", -1)["after"].alias("after"))


def lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bulleted, numbered and lettered lists: runs of two or more items, or of one that an item of another type follows at once."""
    line = F.col("line")
    kinds = [("bulleted", BULLET), ("numbered", NUMBER), ("lettered", LETTER)]
    type_, item = F.lit("other"), F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        type_ = F.when(line.rlike(pattern), name).otherwise(type_)
        item = F.when(line.rlike(pattern), strip(F.regexp_extract(line, pattern, 1))).otherwise(item)
    runs = _islands(lines_of(df, key, text).select(key, "line_num", type_.alias("type"), item.alias("item")), key)
    whole = (F.size("items") >= 2) | (F.col("after").isNotNull() & (F.col("after") != "other"))
    return runs.filter(whole).select(key, "start_line", "type", "items")


def is_upper(line: Column) -> Column:
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")


def is_title(line: Column) -> Column:
    """Every word begins with a capital and goes on in lower case."""
    return line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{L}\p{Lu}") & ~line.rlike(r"(?<!\p{L})\p{Ll}")


def headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines in capitals, and short title-case lines, that look like headings."""
    line = F.col("line")
    n, letters = F.char_length(line), F.char_length(F.regexp_replace(line, r"[^\p{L}]", ""))
    plain = ~line.rlike("[:#]")
    caps = (n > 3) & (n < 80) & is_upper(line) & plain
    words = F.size(F.split(line, r"\s+"))
    title = ~caps & (n > 3) & (n < 60) & is_title(line) & plain & ~line.rlike(r"[,.;]$|^\d") & F.contains(line, F.lit(" ")) & words.between(2, 6)
    good = (caps & (letters >= 3) & (letters > n * 0.5)) | title
    return lines_of(df, key, text).filter(n.between(4, 79) & good).select(key, "line_num", line.alias("header"))


def structured_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with its class in order of precedence: header, pair, bulleted, numbered, data, blank, other; pairs with name and value, items with text."""
    line, n = F.col("line"), F.char_length("line")
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern in reversed(LINE_PAIR_PATTERNS):
        a, b = strip(F.regexp_extract(line, pattern, 1)), strip(F.regexp_extract(line, pattern, 2))
        ok = line.rlike(pattern) & (F.char_length(a) >= 2) & (F.char_length(b) >= 1) & ~a.rlike("^[0-9]")
        name, value = F.when(ok, a).otherwise(name), F.when(ok, b).otherwise(value)
    may_be = line.rlike(MAY_BE_PAIR)
    name, value = F.when(may_be, name), F.when(may_be, value)
    cells = F.when(line.rlike(MAY_BE_CELLS), F.transform(F.split(line, r"\t| {3,}", -1), lambda x: strip(x))).otherwise(F.array().cast("array<string>"))
    class_ = (
        F.when(line == "", "blank")
        .when(is_upper(line) & (n > 3) & (n < 60) & ~F.left(line, F.lit(3)).rlike(r"\d"), "header")
        .when(F.col("name").isNotNull(), "pair").when(line.rlike(BULLET), "bulleted").when(line.rlike(ANY_NUMBER), "numbered")
        .when((F.size(F.col("cells")) >= 2) & ~F.exists("cells", lambda c: c == ""), "data").otherwise("other")
    )
    item = F.when(F.col("class") == "bulleted", strip(F.regexp_extract(line, BULLET, 1))).when(F.col("class") == "numbered", strip(F.regexp_extract(line, ANY_NUMBER, 1)))
    return lines_of(df, key, text).withColumns({"name": name, "value": value, "cells": cells}).withColumn("class", class_).select(
        key, "line_num", "class", F.when(F.col("class") == "pair", F.col("name")).alias("name"), F.when(F.col("class") == "pair", F.col("value")).alias("value"), item.alias("item"), F.when(F.col("class") == "data", F.col("cells")).alias("cells"))


def structured_lists(lines: DataFrame, key: str) -> DataFrame:
    """Lists of structured lines: runs of items of one class, one item is enough."""
    typed = lines.select(key, "line_num", F.when(F.col("class").isin("bulleted", "numbered"), F.col("class")).otherwise("other").alias("type"), "item")
    return _islands(typed, key).select(key, "start_line", "type", "items")


def html_rows(html: Column) -> Column:
    """Texts of the td cells of each tr; cells and rows without text go."""
    clean = lambda x: strip(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]*>", ""), r"\s+", " "))
    rows = F.regexp_extract_all(html, F.lit(r"(?si)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?si)<td\b[^>]*>(.*?)</td>"), F.lit(1)), clean), lambda c: c != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_signature(rows: Column) -> Column:
    return F.to_json(F.slice(rows, 1, 6))


def distinct_tables(df: DataFrame, key: str, order: str, rows: str, most: int = 3, most_rows: int = 10) -> DataFrame:
    """The first tables of a key that differ in their first six rows, cut to ten rows."""
    full = df.filter(F.size(rows) > 0).withColumn("_sig", table_signature(F.col(rows)))
    first = full.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_sig").orderBy(order))).filter("_r = 1")
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most)
    return ranked.withColumn(rows, F.slice(rows, 1, most_rows)).drop("_sig", "_r", "_n")
