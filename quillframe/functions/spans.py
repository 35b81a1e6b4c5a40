"""Match spans and their resolution, as column expressions.

Positions are code points from 0; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
PART = 128
#: Put around matches while a text is cut up. Unicode keeps both for internal use; a text that has one all the same takes two passes.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running totals (inclusive) of an array under an associative merge, in parts, so that time stays near linear in its length."""
    empty = F.array().cast(f"array<{kind}>")

    def scan(part: Column) -> Column:
        return F.aggregate(part, empty, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, merge(F.element_at(acc, -1), v)).otherwise(v))))

    def joined(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast(kind)), scan(F.transform(inner, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda p, o: F.when(o.isNull(), p).otherwise(F.transform(p, lambda v: merge(o, v)))))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(PART)), lambda at: scan(F.slice(v, at, PART)))
        return F.when(F.size(v) == 0, empty).when(F.size(v) <= PART, scan(v)).otherwise(bound(parts, joined))

    return bound(values, whole)


def _placed(pieces: Column) -> Column:
    """pieces: array of (gap, hit), whose lengths add up to the positions."""
    ends = running(F.transform(pieces, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])), lambda a, b: a + b, "int")
    return F.zip_with(ends, pieces, lambda end, x: F.struct((end - F.char_length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("text")))


def marked(text: Column, pattern: str) -> Column:
    """The text with OPEN and CLOSE around each match of a pattern without capturing groups; the text must have neither."""
    return F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}")


def marked_spans(marked_text: Column) -> Column:
    """The matches that `marked` has marked: array of (start, end, text)."""
    none = F.array().cast(f"array<{SPAN}>")

    def cut(parts: Column) -> Column:
        """parts: what OPEN separates, that is, the first gap and then hit, CLOSE, gap."""
        gaps = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.substring_index(p, CLOSE, -1)))
        hits = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.substring_index(p, CLOSE, 1))
        return F.when(F.size(parts) > 1, bound(F.zip_with(F.slice(gaps, 1, F.size(parts) - 1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), _placed)).otherwise(none)

    return bound(F.split(marked_text, OPEN, -1), cut)


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that has no capturing group: array of (start, end, text).

    One pass marks the matches; they and the gaps between them have lengths that add up to the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    twice = bound(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), _placed)
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), twice).otherwise(marked_spans(marked(text, pattern)))


def resolve(items: Column, kind: str, rank: list[str] | None = None) -> Column:
    """Longest spans first, then the earlier item; whatever overlaps a kept span goes; the rest in order of start.

    items: array of a struct (schema `kind`) with start and end (start < end). rank: fields that come before the length. Sorted by
    start, the items fall into clusters that don't overlap each other; the choice is made in each, so that only its own size counts.
    """
    none = F.array().cast(f"array<{kind}>")

    def keep(kept: Column, y: Column) -> Column:
        x = y["x"]
        return F.when(F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"])), kept).otherwise(F.concat(kept, F.array(x)))

    def chosen(cluster: Column) -> Column:
        ranked = F.array_sort(F.transform(cluster, lambda y: F.struct(*[y["x"][r].alias(f"r{n}") for n, r in enumerate(rank or [])], (y["x"]["start"] - y["x"]["end"]).alias("less"), y["i"].alias("i"), y["x"].alias("x"))))
        kept = F.aggregate(ranked, none, keep)
        ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x.alias("x"))))
        return F.when(F.size(cluster) == 1, F.transform(cluster, lambda y: y["x"])).otherwise(F.transform(ordered, lambda y: y["x"]))

    def clusters(order: Column) -> Column:
        reach = running(F.transform(order, lambda y: y["x"]["end"]), lambda a, b: F.greatest(a, b), "int")
        begins = F.zip_with(order, F.concat(F.array(F.lit(None).cast("int")), F.slice(reach, 1, F.size(order) - 1)), lambda y, r: F.coalesce(y["x"]["start"] >= r, F.lit(True)))
        at = F.filter(F.transform(begins, lambda b, i: F.when(b, i + 1)), lambda i: i.isNotNull())
        spread = bound(at, lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(order) + 1)), lambda lo, hi: F.struct(lo.alias("lo"), (hi - lo).alias("n"))))
        return F.flatten(F.transform(spread, lambda c: chosen(F.slice(order, c["lo"], c["n"]))))

    order = F.array_sort(F.transform(items, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x.alias("x"))))
    return F.when(F.size(items) == 0, none).otherwise(bound(order, clusters))


def snippets(text: Column, query: str, around: int = 60, most: int = 5) -> Column:
    """Up to `most` places of a text where the query occurs: (snippet, match_start, match_end) with "..." where cut.

    query must be lower case; matches are found in the lower-cased text and don't overlap.
    """
    gaps = F.split(F.lower(text), "\\Q" + query + "\\E", -1)
    n = len(query)
    starts = F.aggregate(
        F.slice(gaps, 1, F.least(F.size(gaps) - 1, F.lit(most))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, g: F.struct((acc["at"] + F.char_length(g) + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.char_length(g))).alias("out")), lambda acc: acc["out"],
    )
    size = F.char_length(text)

    def one(at: Column) -> Column:
        lo, hi = F.greatest(at - around, F.lit(0)), F.least(at + n + around, size)
        head, tail = F.when(lo > 0, "...").otherwise(""), F.when(hi < size, "...").otherwise("")
        begin = at - lo + F.char_length(head)
        return F.struct(F.concat(head, F.substring(text, lo + 1, hi - lo), tail).alias("snippet"), begin.alias("match_start"), (begin + n).alias("match_end"))

    return F.transform(F.when(F.size(gaps) > 1, starts).otherwise(F.array().cast("array<int>")), one)
